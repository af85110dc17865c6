"""Operators against plain versions and DuckDB, sources on small files, and the whole job."""

import json
import os
import re
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skirmish import registry
from skirmish.functions import clean, names, odds, quality
from skirmish.operators import context, diagnostics, periods, weights
from skirmish.plans import library, snapshot
from skirmish.sources import adapters, catalog, raw

SF = "/root/testdata/sf0.001"
FAST = ["career_records", "bout_scores", "integrity_appearances", "odds_enriched", "entering_streaks", "weight_class_moves", "title_lineage", "prefight_ranks", "win_streaks", "calibration", "division_entropy", "matched_odds", "performance_appearances", "best_period_one_year", "crossing_weights", "rank_movers"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        return None if x is None or x is pd.NA or x != x else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") or type(x).__name__ == "Decimal" else str(x)

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", FAST)
def test_queries_agree_with_sql(spark, duck, name):
    assert rows_of(registry.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(registry.ORACLE[name]).df())


def column(spark, c, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(c).collect()]


def test_scalar_parsers(spark):
    x = F.col("x")
    assert column(spark, clean.height_inches(x), ["5' 11\"", "6'0\"", "--", None]) == [71, 72, None, None]
    assert column(spark, clean.clock_seconds(x), ["4:59", "0:05", "x", ""]) == [299, 5, None, None]
    assert column(spark, clean.percent(x), ["52%", "---"]) == [0.52, None]
    assert column(spark, clean.method_class(x), ["KO/TKO Punch", "TKO - Doctor", "Submission", "SUB", "CNC", "Odd", None]) == ["KO/TKO", "KO/TKO", "Submission", "Submission", "Could Not Continue", "Odd", None]
    assert column(spark, clean.division(x), ["UFC Interim Light Heavyweight Title Bout", "Women's Flyweight Bout", "Catch Weight Bout", "", None]) == ["Light Heavyweight", "Women's Flyweight", "Catch Weight", None, None]
    assert column(spark, clean.title_bout(x), ["UFC Lightweight Title Bout", "Ultimate Fighter 1 Lightweight Title Bout", "UFC 1 Tournament Title Bout", "Lightweight Bout", None]) == [True, False, False, False, False]
    assert column(spark, clean.organisation(x), ["PRIDE 5", "WEC 12", "One Championship 3", "Local"]) == ["PRIDE", "WEC", "ONE", None]
    assert column(spark, clean.crossing_method(x), ["TKO (Punches)", "Technical Submission", "Decision (Split)", "No Contest", "", None]) == ["KO/TKO", "Submission", "Decision - Split", "Overturned", "Other", "Other"]
    assert column(spark, clean.bout_sides(x)[1], ["A vs. B", "A vs. B vs. C", None]) == ["B", None, None]
    assert column(spark, names.compact(names.folded(x)), [" José Aldo-Ruiz ", None]) == ["josealdoruiz", None]
    assert column(spark, quality.scheduled_rounds(x), ["5 Rnd (5-5)", "No Time Limit", None]) == [5, 3, 3]


def test_odds_math(spark):
    x = F.col("x")
    assert column(spark, odds.american_prob(x), [100.0, -200.0, 0.0, float("nan"), None], "double") == [0.5, pytest.approx(2 / 3), None, None, None]
    assert column(spark, odds.decimal_to_american(odds.american_to_decimal(x)), [250.0, -140.0], "double") == [pytest.approx(250), pytest.approx(-140)]
    rows = spark.createDataFrame([("a", "b", -110.0, -110.0, None, None), ("a", "b", None, None, 3.0, 1.5), ("a", "b", -150.0, None, None, None)], "fighter_a string, fighter_b string, american_odds_a double, american_odds_b double, decimal_odds_a double, decimal_odds_b double")
    got = odds.enriched(rows).collect()
    assert [r.favorite for r in got] == [None, "b", None] and [r.odds_data_quality for r in got] == ["ok", "ok", "one_side_missing"]


def test_sleeve_weights_keep_their_envelope(spark):
    rows = registry.QUERIES["performance_appearances"](spark, SF).toPandas()
    assert rows.performance_weight.between(0.8, 1.2).all()
    draws = adapters.bouts(spark, SF).where("is_draw").select("bout_id").toPandas().bout_id
    assert (rows[rows.bout_id.isin(draws)].performance_weight == 1).all()


def test_crowded_cards_and_unknown_winners(spark):
    """Several bouts of one competitor in one event; a missing winner ends a streak; nothing of the event is seen before it."""
    cols = "bout_id long, event_date date, event_name string, fighter_a string, fighter_b string, winner string, is_draw boolean, division string, is_title boolean, is_interim boolean, method_class string"
    d = pd.to_datetime(["2001-01-01", "2001-01-01", "2001-02-01", "2001-03-01", "2001-04-01"]).date
    rows = [(1, d[0], "x", "A", "B", "A", False, "Lightweight", True, False, "DQ"), (2, d[1], "x", "A", "C", "A", False, "Lightweight", False, False, "DQ"), (3, d[2], "y", "B", "A", None, False, "Welterweight", False, False, "DQ"), (4, d[3], "z", "A", "C", "A", False, "Welterweight", True, True, "DQ"), (5, d[4], "w", "A", "B", "B", False, "Welterweight", True, False, "DQ")]
    b = adapters.sequenced(spark.createDataFrame(rows, cols))
    from skirmish.operators.reshape import appearances

    apps = appearances(b)
    assert {(r.bout_id, r.fighter): r.streak for r in context.win_streaks(apps).collect() if r.fighter == "A"} == {(1, "A"): 0, (2, "A"): 0, (3, "A"): 2, (4, "A"): 0, (5, "A"): 1}
    moves = {(r.bout_id, r.fighter): r.move for r in context.class_moves(apps).collect()}
    assert moves[3, "A"] == "up" and moves[4, "A"] == "same" and moves[1, "A"] == "unknown" and moves[4, "C"] == "up"
    held = {r.bout_id: r for r in context.title_lineage(b).collect()}
    assert not held[1].entered_champion_a and held[5].entered_interim_a and not held[4].entered_champion_a


def test_only_those_who_appear_are_ranked(spark):
    """a row for each appearance, not for each event and active competitor; ranks as by brute force, also where history lacks an event."""
    import random

    from skirmish.operators.reshape import appearances

    random.seed(3)
    names_, days = [f"S{i}" for i in range(12)], pd.date_range("2000-01-20", periods=40, freq="37D").date
    rows = []
    for i in range(120):
        x, y = random.sample(names_, 2)
        day = random.choice(days)
        rows.append((i, day, f"E{day}", x, None if i == 77 else y, random.choice([x, None]), False, random.choice(["Lightweight", "Flyweight", None]), False, False, "DQ"))
    b = adapters.sequenced(spark.createDataFrame(rows, "bout_id long, event_date date, event_name string, fighter_a string, fighter_b string, winner string, is_draw boolean, division string, is_title boolean, is_interim boolean, method_class string"))
    apps = appearances(b)
    lone = apps.where("bout_id = 77 and fighter is not null").first()
    history = adapters.surrogate_history(apps.where("fighter is not null")).where(~((F.col("fighter") == lone.fighter) & (F.col("event_seq") == lone.event_seq)))
    got = {(r.bout_id, r.side): (r.ranked_division, r.p4p_rank, r.division_rank) for r in context.ranks(b, apps, history, context.DEFAULT.with_(active_days=200)).collect()}
    all_, states = apps.toPandas(), history.toPandas()
    want = {}
    for r in all_[all_.fighter.notna()].itertuples():
        live = {}
        for s in states[states.event_seq < r.event_seq].sort_values("event_seq").itertuples():
            top = all_[(all_.fighter == s.fighter) & (all_.event_seq == s.event_seq)].sort_values("bout_id").division.iloc[-1]
            live[s.fighter] = (-s.mu, s.fighter, top, s.event_date)
        order = sorted((x for x in live.values() if (r.event_date - x[3]).days <= 200), key=lambda x: x[:2])
        if (me := next((x for x in order if x[1] == r.fighter), None)) is not None:
            want[r.bout_id, r.side] = (me[2], order.index(me) + 1, [x for x in order if x[2] == me[2]].index(me) + 1 if me[2] else None)
    assert len(want) > 100 and (77, lone.side) in got and got == want


def test_small_pools_are_not_normalised_and_empty_ones_pass(spark):
    rows = spark.createDataFrame([("s", f"f{i % 3}", pd.Timestamp(2000 + i % 4, 1, 1).date(), "e", i, "d", 1500.0 + i) for i in range(40)], "stream string, fighter string, event_date date, event_name string, bout_id long, division string, mu double")
    assert periods.normalised(rows).where("mu <> mu_norm").count() == 0 and periods.normalised(rows.limit(0)).count() == 0
    assert diagnostics.calibration(spark.createDataFrame([], "p_win double, actual double, division string, stance string")).count() == 0


RANKING = '<table class="tblRank"><tr><td>Rank</td></tr><tr><td>1</td><td><a href="/fighter-profile/x/1">Some One (29)</a></td><td>17-0-0</td><td>2965</td></tr><tr><td>2</td><td>x</td><td>y</td><td><a href="/fighter-profile/y/2">No Age</a></td><td>9-1</td><td>100.5</td><td>Last Fight: won</td><td>Next Fight: soon</td></tr></table>'
HISTORY = "<table><tr><th>Result</th><th>Fighter</th><th>Event</th><th>Method/Referee</th><th>R</th><th>Time</th></tr><tr><td>win</td><td>Foe</td><td><a>Pride 9</a> Jun / 4 / 2001</td><td>TKO (Punches) VIEW PLAY-BY-PLAY</td><td>2</td><td>4:10</td></tr><tr><td>upcoming</td><td>Q</td><td>z</td><td>-</td><td>1</td><td>x</td></tr></table>"


def test_pages_are_parsed(spark):
    got = raw.rankings(spark.createDataFrame([("LW", RANKING), ("none", "<p>"), ("null", None)], "division string, html string")).orderBy("rank").collect()
    assert [(r.fighter, r.age, r.points) for r in got] == [("Some One", 29, 2965.0), ("No Age", None, 100.5)] and got[1].last_fight_text == "won"
    bouts = raw.histories(spark.createDataFrame([("Me", HISTORY)], "fighter string, html string"))
    r = bouts.first()
    assert (r.org, r.method_class, str(r.event_date), r.end_time_seconds) == ("PRIDE", "KO/TKO", "2001-06-04", 250) and bouts.count() == 1
    cross = raw.crossing_bouts(bouts, spark.createDataFrame([("Me",)], "fighter string"))
    assert cross.first().winner == "Me"


def test_an_export_becomes_a_snapshot_and_a_catalog(spark, tmp_path):
    folder, out = tmp_path / "raw", tmp_path / "snap" / "2024-01-02"
    folder.mkdir()
    text = {
        "events": "EVENT,URL,DATE,LOCATION\nCard 1,e/1,\"January 5, 2024\",X\nOld,e/0,\"March 1, 1999\",X\n",
        "results": "EVENT,BOUT,OUTCOME,WEIGHTCLASS,METHOD,ROUND,TIME,TIME FORMAT,REFEREE,DETAILS,URL\nCard 1,A One vs. B Two,W/L,UFC Lightweight Title Bout,KO/TKO,1,2:03,5 Rnd (5-5-5-5-5),R,,u/1\nCard 1,C Three vs. D Four,NC/NC,Lightweight Bout,Overturned,1,1:00,3 Rnd,R,failed drug test by Four,u/2\nOld,A One vs. C Three,W/L,Open,DQ,1,1:00,,R,,u/0\n",
        "stats": "EVENT,BOUT,ROUND,FIGHTER,KD,SIG.STR.,SIG.STR. %,TOTAL STR.,TD,TD %,SUB.ATT,REV.,CTRL,HEAD,BODY,LEG,DISTANCE,CLINCH,GROUND\nCard 1,A One vs. B Two,Round 1,A One,1,5 of 11,45%,6 of 12,0 of 0,---,1,0,1:05,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2\nOld,A One vs. C Three,Round 1,A One,1,5 of 11,45%,6 of 12,0 of 0,---,1,0,1:05,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2,1 of 2\n",
        "details": "FIRST,LAST,NICKNAME,URL\nA,One,Ace,f/1\n", "tale": "FIGHTER,HEIGHT,WEIGHT,REACH,STANCE,DOB,URL\nA One,\"5' 11\"\"\",155 lbs.,\"70\"\"\",Orthodox,\"Jan 2, 1990\",f/1\n",
    }
    for name, body in text.items():
        (folder / raw.RAW_FILES[name][0]).write_text(body)
    assert raw.build_snapshot(spark, str(folder), str(out)) == {"rated": 1, "method_overturned": 1, "pre_unified_rules": 1}
    bout = spark.read.parquet(f"{out}/canonical_fights.parquet").first()
    assert (bout.winner, bout.end_time_seconds, bout.method_score_winner, bout.is_title_fight) == ("A One", 123, 1.0, True)
    assert spark.read.parquet(f"{out}/excluded_fights.parquet").where("ped_flagged_fighter = 'D Four'").count() == 1
    rounds = spark.read.parquet(f"{out}/canonical_rounds.parquet").collect()
    assert len(rounds) == 1 and rounds[0].sig_str_landed == 5 and rounds[0].ctrl_seconds == 65
    fighter = spark.read.parquet(f"{out}/canonical_fighters.parquet").first()
    assert (fighter.height_inches, fighter.weight_lb, fighter.reach_inches, str(fighter.dob)) == (71, 155, 70.0, "1990-01-02")
    assert catalog.latest(spark, str(tmp_path / "snap")) == "2024-01-02"
    assert set(catalog.load(spark, str(out))) == {"canonical_events", "canonical_fights", "canonical_rounds", "canonical_fighters"}
    lacks = {r.table_name: r.gap for r in catalog.gaps(spark, ["canonical_fights"]).collect()}
    assert lacks["ratings_current"] == "missing_required" and "canonical_fights" not in lacks


def test_markdown_tables(spark, tmp_path):
    path = tmp_path / "n.md"
    path.write_text("## One\n| a | b |\n|---|---|\n| 1 | 2 |\n### Sub\n| c | d |\n## Two\n| e | f |\n")
    got = [(r.section, r.subsection, r.cells) for r in raw.markdown_tables(spark, str(path)).orderBy("line").collect()]
    assert got == [("One", None, ["a", "b"]), ("One", None, ["1", "2"]), ("One", "Sub", ["c", "d"]), ("Two", None, ["e", "f"])]


def test_the_whole_job(spark):
    g = registry.Given(spark, SF)
    out = snapshot.run(g.bouts.drop("event_seq"), g.rounds, g.odds)
    current = out["current"].toPandas()
    assert len(current) == 10 and current.mu_canonical.is_monotonic_decreasing
    assert {"mu_method_integrity_performance", "mu_whr_performance", "five_year_headline_mu_whr", "ten_year_mu_canonical", "recent_division"} <= set(current.columns)
    history = out["history"].toPandas()
    assert set(history.stream) == {"canonical", "method", "method_integrity", "method_performance", "method_integrity_performance"}
    assert out["whr"].groupBy("stream").count().count() == 4 and out["resume"].count() > 0
    assert abs(out["attribution"].selectExpr("sum(base_delta + integrity_delta + performance_delta + interaction_delta - combined_delta) as d").first().d) < 1e-6
    assert library.rating_column(list(current.columns), "Legacy", "Prime") == "ten_year_headline_mu_whr"
    with pytest.raises(ValueError):
        library.stream_of("canonical", integrity=True)


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['skirmish.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) == len(registry.QUERIES) and "False" in said.stdout
    for top, _, files in os.walk(os.path.join(repo, "skirmish")):
        if "llm" not in top:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(top, f), encoding="utf-8").read())


def test_schema_notes_name_all_columns(spark):
    note = json.loads(raw.schema_note(spark.createDataFrame([(1, "x")], "a int, b string"), ["a"], "row"))
    assert note["primary_key"] == ["a"] and [c["name"] for c in note["columns"]] == ["a", "b"]


def test_periods_of_streams_side_by_side_equal_those_of_rows_for_each_stream(spark):
    import datetime
    import random

    draw, rows = random.Random(5), []
    for i in range(900):
        title, won = draw.random() < 0.3, draw.random() < 0.5
        day = datetime.date(2000, 1, 1) + datetime.timedelta(days=draw.randrange(3000))
        mus = [draw.gauss(1500, 90) if draw.random() < 0.8 else None for _ in range(3)]
        rows.append((f"f{i % 12}", day, f"Card {day}", i, draw.choice(["Flyweight", "Lightweight", None]), title, float(won), draw.choice([0.0, 0.5, 1.5]), draw.choice([None, 4.0, -2.5]), draw.random(), int(title), int(title and won), 0, mus))
    kinds = "fighter string, event_date date, event_name string, bout_id long, division string, is_title boolean, actual_score double, period_weight double, adjustment double, opp_weight double, t_bout int, t_win int, t_defense int, mus array<double>"
    wide, streams, specs = spark.createDataFrame(rows, kinds), ["x", "y", "z"], {"short": (400, 8, 6), "long": (1825, 8, 6)}
    each = wide.select("*", F.posexplode("mus")).where("col is not null").withColumns({"stream": F.array(*map(F.lit, streams))[F.col("pos")], "mu": F.col("col")}).drop("pos", "col", "mus")
    old, found = periods.normalised(each), periods.normalised_side_by_side(wide, streams)
    assert old.where("abs(mu - mu_norm) > 1").count() > 100
    best = periods.best_side_by_side(found, specs, streams)
    for label, spec in specs.items():
        a, b = ({(r.stream, r.fighter): r for r in x.collect()} for x in (periods.best_periods(old, *spec), best[label]))
        assert a and a.keys() == b.keys()
        for k, one in a.items():
            assert (one.n, one.end_rn) == (b[k].n, b[k].end_rn) and all(abs(one[c] - b[k][c]) < 1e-6 for c in ("period_score", "headline_score", "score", "effective", "so", "ladder", "var")), k


def test_a_lean_run_stores_no_table_longer_than_it_is_read(spark, monkeypatch):
    stored, taken = [], []
    put, drop = snapshot.cut, snapshot.dropped
    monkeypatch.setattr(snapshot, "cut", lambda df, name: stored.append((name, out := put(df, name))) or out)
    monkeypatch.setattr(snapshot, "dropped", lambda *tables: taken.extend(tables) or drop(*tables))
    rows = registry.QUERIES["rating_run"](spark, SF).toPandas()
    assert len(rows) == 10 and rows.mu_canonical.is_monotonic_decreasing and rows.mu_whr_performance.notna().all()
    left = {name for name, df in stored if not any(df is x for x in taken)}
    assert {"now", "last", "bouts"} <= left and not left & {"base", "sleeves", "whr", "performance", "weighted", "beside", "dominance"}
