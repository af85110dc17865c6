"""Boards, labels, other organisations' bouts, the catalog and pools, against SQL and on small cases."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from skirmish import registry, registry_boards  # noqa: F401  registered by import
from skirmish.operators import kernels, spread, weights
from skirmish.plans import boards, crossing, labels, snapshot
from skirmish.sources import adapters, catalog, raw

from test_engine import SF, rows_of

FAST = ["sleeve_ranking", "period_leaderboard", "gendered_leaderboard", "streaks_by_quality", "moved_with_odds", "fighters_by_text", "crossing_bouts", "crossing_summary", "merged_metrics", "ranking_pages", "metric_ranks", "outside_rank_gap"]


@pytest.mark.parametrize("name", FAST)
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("supplier", "part", "orders", "lineitem", "nation"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(con.sql(registry.ORACLE[name]).df())


def test_columns_are_resolved_and_labelled(spark):
    have = ["mu_canonical", "mu_method", "five_year_peak_mu_method", "sustained_peak_headline_mu_whr"]
    assert labels.backing_column(have, "canonical") == "mu_canonical" and labels.backing_column(have, "whr") is None
    assert labels.backing_column(have, "method_integrity", "five_year_peak") == "five_year_peak_mu_method"
    assert labels.backing_column(have, "whr", "sustained_peak") == "sustained_peak_headline_mu_whr"
    assert labels.backing_column(["five_year_peak_mu_whr"], "whr", "sustained_peak") == "five_year_peak_mu_whr"
    assert labels.composed_column(have, "method") == "mu_method"
    assert labels.composition("method", True, True)["label"] == "Complete" and labels.composition("method", True)["detail"] == "Finishes with clean"
    assert labels.composition("canonical") == {"stream": "canonical", "label": "Wins", "detail": "Wins with no context", "baseline_col": "mu_canonical", "baseline_label": "Wins"}
    assert labels.prime_columns("whr", 7) == ("prime_7yr_mu_whr", "prime_7yr_headline_mu_whr") and labels.prime_columns("whr", 7, 9)[0] == "prime_7yr_9f_mu_whr"
    assert labels.prime_spec(10) == (3652, 13, 10) and labels.prime_spec(3, 12) == (1096, 12, 9)
    assert labels.view_label("legacy", "sustained_peak") == "Prime Legacy" and labels.history_table("legacy") == "ratings_history_whr" and labels.history_table("x") == "ratings_history"
    assert labels.metric_label("mu_whr") == "Legacy rating" and labels.metric_label("n_bouts") == "n bouts" and labels.stream_of_column("five_year_peak_mu_whr") == "whr"
    assert labels.labelled(spark.createDataFrame([(1.0, 2.0)], "sustained_peak_headline_mu_whr double, x double")).columns == ["Legacy", "x"]
    for wrong in (lambda: labels.lens_stream("x"), lambda: labels.backing_column(have, "whr", "x")):
        with pytest.raises(ValueError):
            wrong()


def test_crossing_bouts_take_the_decided_row_and_known_names(spark):
    current = spark.createDataFrame([("José Aldo", "Featherweight", 1600.0, 5), ("Bo", None, 1500.0, 5)], "fighter string, recent_division string, mu double, rating_periods int")
    day = dt.date(2005, 1, 1)
    rows = [
        ("k1", 1, "jose aldo", "X", "nc", "E", day, "WEC"), ("k1", 2, "X", "Jose  Aldo", "loss", "E", day, "WEC"), ("k2", 3, "X", "Y", "win", "E", day, "WEC"),
        ("k3", 4, "Bo", "X", "draw", "E", dt.date(1999, 1, 1), "PRIDE"), ("k4", 5, "Bo", "X", "draw", "E", day, "PRIDE"), ("k5", 6, "Bo", "X", "win", "E", None, "PRIDE"),
    ]
    frame = spark.createDataFrame([(*r, "Submission") for r in rows], "fight_key string, ord int, fighter string, opponent string, result string, event_name string, event_date date, org string, method_class string")
    got = {r.fight_key: r for r in crossing.canonical(frame, crossing.known_names(current)).collect()}
    assert set(got) == {"k1", "k4"}
    assert (got["k1"].winner, got["k1"].fighter_b, got["k1"].weight_class, got["k1"].is_nc) == ("José Aldo", "X", "Featherweight", False)
    assert got["k4"].winner is None and got["k4"].is_draw and got["k4"].weight_class == "Open Weight"


def test_a_crossing_snapshot_is_staged(spark, tmp_path):
    base, new = str(tmp_path / "base"), str(tmp_path / "new")
    people = [(f"P{i}", "Heavyweight", 1400.0 + i, 5) for i in range(6)]
    spark.createDataFrame(people, "fighter string, recent_division string, mu double, rating_periods int").write.parquet(f"{base}/ratings_current.parquet")
    rows = [(f"k{i}", i, f"p{i}", f"P{i + 1}", "win", "E", dt.date(2005, 1, 1), "WEC", "DQ") for i in range(5)]
    raw_rows = spark.createDataFrame(rows, "fight_key string, ord int, fighter string, opponent string, result string, event_name string, event_date date, org string, method_class string")
    got = crossing.stage(spark, base, new, raw_rows).collect()
    assert [(r.org, r.bouts) for r in got] == [("WEC", 5)] and 0.5 <= got[0].mean_weight <= 1
    assert spark.read.parquet(f"{new}/ratings_current.parquet").count() == 6 and spark.read.text(f"{new}/org_weights.json").first()[0].startswith('{"WEC"')


def test_odds_are_written_once_a_bout(spark, tmp_path):
    folder = str(tmp_path)
    assert not raw.has_odds(spark, folder) and raw.odds_lines(spark, folder).isEmpty()
    bouts = spark.createDataFrame([(1, "A", "B", dt.date(2020, 1, 1)), (2, "C", "D", dt.date(2020, 1, 1))], "bout_id long, fighter_a string, fighter_b string, event_date date")
    vendor = spark.createDataFrame([("a", "b", -120.0, 100.0, dt.date(2020, 1, 2), "a|b")], "R_fighter string, B_fighter string, R_odds double, B_odds double, odds_date date, pair_key string")
    from skirmish.functions import clean

    vendor = vendor.withColumn("pair_key", clean.pair_key(F.col("R_fighter"), F.col("B_fighter")))
    assert raw.write_odds(bouts, vendor, folder) == {"ok": 1} and raw.write_odds(bouts, vendor, folder) == {"ok": 1}
    assert raw.has_odds(spark, folder) and raw.odds_lines(spark, folder).count() == 1
    assert raw.aliases(spark, f"{folder}/none.csv").isEmpty() and raw.curated_findings(spark, f"{folder}/none.csv").isEmpty()


def test_the_catalog_lists_loads_and_copies(spark, tmp_path):
    folder, database = str(tmp_path / "2020-01-01"), "boards_test"
    for name in ("canonical_events", "canonical_fights", "ratings_current", "ratings_history"):
        spark.createDataFrame([("A", dt.date(2020, 1, 1), True, [1])], "fighter string, event_date date, flag boolean, parts array<int>").write.parquet(f"{folder}/{name}.parquet")
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    try:
        catalog.publish(spark, folder, database)
        assert "ratings_current" in catalog.listed(spark, database) and catalog.sorted_count(spark, database) >= 4
        assert set(catalog.load_any(spark, folder, database, True)) == set(catalog.load_any(spark, folder)) == {"canonical_events", "canonical_fights", "ratings_current", "ratings_history"}
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    assert catalog.modified(spark, f"{folder}/ratings_current.parquet").first().modified.endswith("Z")
    row = catalog.rendered(spark.read.parquet(f"{folder}/ratings_current.parquet")).first()
    assert (row.event_date, row.flag, row.parts) == ("2020-01-01", 1, "[1]")
    (tmp_path / "a.csv").write_text("x\n")
    assert catalog.copied(spark, str(tmp_path), str(tmp_path / "raw"), ["a.csv", "b.csv"]) == ["a.csv"] and (tmp_path / "raw" / "a.csv").read_text() == "x\n"
    old, new = (spark.createDataFrame(rows, "fighter string, mu double") for rows in ([("A", 1500.0)], [("A", 1510.0), ("B", 1400.0)]))
    text = catalog.changelog_entry("2020-01-01", {"bouts": 1200}, old, new)
    assert "- bouts: 1,200" in text and "new competitors: 1" in text and "median 10.0" in text
    for _ in range(2):
        catalog.append_text(spark, str(tmp_path / "log.md"), text)
    assert (tmp_path / "log.md").read_text().count("## 2020-01-01") == 2


def test_lab_files_become_tables(spark, tmp_path):
    (tmp_path / "events.csv").write_text("Event Name,Event Date\nOne,3/2/2020\nTwo,5/2/2020\n")
    notes = raw.lab_snapshot(spark, str(tmp_path), str(tmp_path / "out"), {"events": "event_date"})
    assert notes == {"events": {"rows": 2, "min_date": "2020-02-03", "max_date": "2020-02-05"}}


def test_running_totals_and_pools(spark):
    rows = spark.createDataFrame([(float(i * 7 % 50), i) for i in range(50)], "v double, n long").repartition(7)
    got = {r.v: (r["_before"], r["_all"]) for r in spread.totals_before(rows, F.col("v").asc(), "n").collect()}
    by = sorted((float(i * 7 % 50), i) for i in range(50))
    assert got == {v: (sum(n for _, n in by[:k]), sum(range(50))) for k, (v, _) in enumerate(by)}
    edges = [(f"a{i}", f"a{i + 1}") for i in range(9)] + [("b1", "b2"), ("c2", "c1"), ("c2", "c3")]
    found = {r.name: r.pool for r in spread.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert set(found.values()) == {"a0", "b1", "c1"} and all(found[f"a{i}"] == "a0" for i in range(10))


def test_fields_without_a_common_competitor_are_rated_apart(spark):
    bouts = []
    for k, field in enumerate("xyz"):
        for i in range(12):
            bouts.append((100 * k + i, dt.date(2020, 1, 1 + i), f"E{i}", f"{field}{i % 4}", f"{field}{(i + 1 + i % 2) % 4}", i + 1))
    df = spark.createDataFrame(bouts, "bout_id long, event_date date, event_name string, fighter_a string, fighter_b string, event_seq long").where("fighter_a <> fighter_b")
    df = df.withColumns({"winner": F.col("fighter_a"), "is_draw": F.lit(False), "score": F.lit(1.0)})
    pools = snapshot.pooled(df)
    assert {r.pool for r in pools.collect()} == {"x0", "y0", "z0"}
    apart = kernels.rate_streams(kernels.for_streams(pools, {"canonical": {"score": "score"}}))
    whole = kernels.rate_streams(kernels.for_streams(df, {"canonical": {"score": "score"}}))
    got, want = ({(r.fighter, r.event_seq): round(r.mu, 6) for r in x.collect()} for x in (apart, whole))
    assert got == want and apart.select("pool").distinct().count() == 3


def test_glicko_streams_rate_pools_in_tasks_of_their_own(spark, monkeypatch):
    """fields without a common competitor don't share a task; the rows are those of one pool."""
    from skirmish import registry

    b = [(i, dt.date(2020, 1, 1 + i % 9), f"E{i % 9}", f"{k}{i % 3}", f"{k}{(i + 1) % 3}") for i, k in enumerate("xyz" * 12)]
    df = spark.createDataFrame(b, "bout_id long, event_date date, event_name string, fighter_a string, fighter_b string").where("fighter_a <> fighter_b")
    df = adapters.sequenced(df.withColumns({"winner": F.col("fighter_a"), "is_draw": F.lit(False), "quality_score": F.lit(0.9)}))
    seen, rate = [], kernels.rate_streams
    monkeypatch.setattr(registry, "_kernel_bouts", lambda *_: df)
    monkeypatch.setattr(kernels, "rate_streams", lambda rows, *a: seen.append({r.pool for r in rows.select("pool").distinct().collect()}) or rate(rows, *a))
    got, want = (sorted((r.stream, r.pool, r.fighter, r.event_seq, round(r.mu, 9), round(r.phi, 9)) for r in x.collect()) for x in (registry.QUERIES["glicko_streams"](spark, ""), snapshot.base_history(df)))
    assert got == want and len(seen[0]) == 3


def test_bouts_without_flags_are_scored(spark):
    bouts = adapters.bouts(spark, SF)
    plain = bouts.drop(*weights.FLAGS)
    assert weights.scored(plain).where("quality_score < 0.7").isEmpty() and weights.integrity_appearances(plain).where("integrity_factor_ped < 1").isEmpty()


def test_texts_filter_competitors_and_labels_prefer_the_longest(spark):
    rows = spark.createDataFrame([("José Aldo",), ("Ed Josephs",), ("Bo",)], "fighter string")
    assert {r.fighter for r in boards.of_fighter(rows, "JOSE").collect()} == {"José Aldo", "Ed Josephs"} and boards.of_fighter(rows, " - ").count() == 3
    got = spark.createDataFrame([("UFC Women's Strawweight Title Bout",), ("Light Heavyweight Bout",), ("UFC Superfight Bout",), (None,)], "w string").select(boards.chart_division(F.col("w"))).collect()
    assert [r[0] for r in got] == ["Women's Strawweight", "Light Heavyweight", "Superfight", None]
