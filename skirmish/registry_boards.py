"""Registered queries of leaderboards, chart frames, other organisations' bouts and the catalog, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import DEFAULT
from .operators import context
from .plans import boards, crossing, labels
from .registry import CURRENT_SQL, ORACLE, PERIOD_SQL, Given, _period, query, r
from .registry import division_entropy as _entropy_query
from .registry import division_strength as _strength_query
from .sources import catalog, raw
from .sources.adapters import ODDS_SQL

WIDE_SQL = CURRENT_SQL + """, wide AS (SELECT c.*, c.mu AS mu_canonical, c.mu + c.phi / 10.0 AS mu_method, p.best + 5 AS sustained_peak_headline_mu_whr, p.best AS five_year_peak_headline_mu_whr, c.phi / 10.0 - 8 AS delta
  FROM current c JOIN (SELECT fighter, max(mu) AS best FROM history GROUP BY fighter) p USING (fighter))"""


def _wide(g: Given) -> DataFrame:
    """Current ratings of two streams with best periods, from the surrogate rating."""
    best = g.history.groupBy("fighter").agg(F.max("mu").alias("best"))
    mu, phi = F.col("mu"), F.col("phi") / 10.0
    return g.current.join(best, "fighter").withColumns({"mu_canonical": mu, "mu_method": mu + phi, "sustained_peak_headline_mu_whr": F.col("best") + 5, "five_year_peak_headline_mu_whr": F.col("best"), "delta": phi - 8}).drop("best")


def _day(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# ---- leaderboards


@query(WIDE_SQL + """, k AS (SELECT *, row_number() OVER (ORDER BY mu_method DESC, fighter) AS rank FROM wide WHERE rating_periods >= 3)
SELECT rank, fighter, round(mu_method, 1) AS current_rating, round(mu, 1) AS baseline_rating, round(mu_method - mu, 1) AS delta_vs_baseline, CAST(last_event_date AS VARCHAR) AS last_event_date, contains(lower(fighter), 's1') AS query_match FROM k WHERE rank <= 25""")
def sleeve_ranking(spark, sf_dir):
    return _day(boards.sleeve_ranking(_wide(Given(spark, sf_dir)), "mu_method", query=" S1"), "last_event_date")


@query(WIDE_SQL + """, k AS (SELECT *, row_number() OVER (ORDER BY mu_method DESC, fighter) AS rank FROM wide WHERE rating_periods >= 3 AND recent_division = 'Heavyweight' AND date_diff('day', last_event_date, (SELECT max(last_event_date) FROM wide)) <= 365)
SELECT rank, fighter, round(mu_method, 1) AS current_rating, round(mu, 1) AS baseline_rating, round(mu_method - mu, 1) AS delta_vs_baseline, CAST(last_event_date AS VARCHAR) AS last_event_date FROM k WHERE rank <= 10""")
def sleeve_ranking_division(spark, sf_dir):
    return _day(boards.sleeve_ranking(_wide(Given(spark, sf_dir)), "mu_method", n=10, division="Heavyweight", active_within=365), "last_event_date")


@query(WIDE_SQL + """, k AS (SELECT *, row_number() OVER (ORDER BY sustained_peak_headline_mu_whr DESC, fighter) AS rank FROM wide WHERE rating_periods >= 13)
SELECT rank, fighter, round(sustained_peak_headline_mu_whr, 1) AS period_rating, round(five_year_peak_headline_mu_whr, 1) AS five_year_rating, rating_periods, 'sustained_peak_headline_mu_whr' AS rating_column FROM k WHERE rank <= 25""")
def period_leaderboard(spark, sf_dir):
    return boards.period_leaderboard(_wide(Given(spark, sf_dir)))


@query(WIDE_SQL + """, x AS (SELECT *, CASE WHEN recent_division LIKE 'Women''s%' THEN 'F' ELSE 'M' END AS gender FROM wide WHERE rating_periods >= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY mu_method DESC, fighter) AS rank FROM x)
SELECT gender, rank, fighter, round(mu_method, 1) AS rating, round(mu_method - mu, 1) AS vs_wins, recent_division AS division, CAST(last_event_date AS VARCHAR) AS last_event_date, rating_periods FROM k WHERE rank <= 15""")
def gendered_leaderboard(spark, sf_dir):
    return _day(boards.gendered_leaderboard(_wide(Given(spark, sf_dir)), "mu_method"), "last_event_date")


@query(WIDE_SQL + """, k AS (SELECT *, row_number() OVER (ORDER BY mu DESC, fighter) AS rank FROM wide WHERE rating_periods >= 3)
SELECT k.fighter, k.rank, k.mu, CAST(60 + s.s_nationkey AS INTEGER) AS height FROM k LEFT JOIN supplier s ON k.fighter = 'S' || s.s_suppkey WHERE k.rank <= 25""")
def tape_leaderboard(spark, sf_dir):
    tape = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("S"), "s_suppkey").alias("fighter"), (60 + F.col("s_nationkey")).cast("int").alias("height"))
    return boards.tape_leaderboard(_wide(Given(spark, sf_dir)), tape, "mu").select("fighter", "rank", "mu", "height")


STREAKS_SQL = CURRENT_SQL + """, o AS (SELECT *, CASE WHEN is_draw THEN 'draw' WHEN is_winner THEN 'win' ELSE 'loss' END AS outcome FROM apps),
i AS (SELECT *, sum(CASE WHEN outcome = 'win' THEN 0 ELSE 1 END) OVER (PARTITION BY fighter ORDER BY event_date, event_name, bout_id ROWS UNBOUNDED PRECEDING) AS island FROM o),
st AS (SELECT fighter, island, count(*) AS length, min(event_date) AS start_date, max(event_date) AS end_date, count(*) FILTER (is_title) AS title_wins FROM i WHERE outcome = 'win' GROUP BY 1, 2 HAVING count(*) >= 3),
sr AS (SELECT s.fighter, s.start_date, any_value(s.length) AS length, any_value(s.title_wins) AS title_wins, avg(c.mu) AS avg_opp_rating, list_sort(list(DISTINCT a.division)) AS divisions
  FROM st s JOIN apps a ON a.fighter = s.fighter AND a.is_winner AND a.event_date BETWEEN s.start_date AND s.end_date LEFT JOIN current c ON c.fighter = a.opponent GROUP BY s.fighter, s.start_date),
sg AS (SELECT *, CASE WHEN len(list_filter(divisions, lambda d: d LIKE 'Women''s%')) > 0 THEN 'F' ELSE 'M' END AS gender FROM sr)"""
_STREAK_COLUMNS = " SELECT fighter, CAST(start_date AS VARCHAR) AS start_date, length, title_wins, round(avg_opp_rating, 6) AS avg_opp_rating, gender FROM sg "


def _streaks(g: Given) -> DataFrame:
    return boards.rated_streaks(context.all_streaks(g.apps, 3), g.apps.where("is_winner"), g.current)


def _streak_rows(df: DataFrame) -> DataFrame:
    return _day(df.select("fighter", "start_date", "length", "title_wins", r("avg_opp_rating").alias("avg_opp_rating"), "gender"), "start_date")


@query(STREAKS_SQL + _STREAK_COLUMNS + "ORDER BY round(avg_opp_rating, 9) DESC, length DESC, title_wins DESC, fighter, start_date LIMIT 25")
def streaks_by_quality(spark, sf_dir):
    rows = _streaks(Given(spark, sf_dir)).withColumn("avg_opp_rating", r("avg_opp_rating", 9))
    return _streak_rows(boards.streak_table(rows, sort_by="quality"))


@query(STREAKS_SQL + _STREAK_COLUMNS + "WHERE gender = 'F' AND list_contains(divisions, 'Heavyweight') ORDER BY title_wins DESC, length DESC, round(avg_opp_rating, 9) DESC, fighter, start_date LIMIT 25")
def streaks_by_titles(spark, sf_dir):
    rows = _streaks(Given(spark, sf_dir)).withColumn("avg_opp_rating", r("avg_opp_rating", 9))
    return _streak_rows(boards.streak_table(rows, division="Heavyweight", gender="F", sort_by="title_wins"))


ODDS_ROWS = """, fo AS (SELECT fighter, count(p) AS n_odds, median(p) AS median_prob FROM (SELECT fighter_a AS fighter, prob_a AS p FROM lines_ok WHERE odds_data_quality = 'ok' UNION ALL SELECT fighter_b, prob_b FROM lines_ok WHERE odds_data_quality = 'ok') GROUP BY 1)"""


@query(WIDE_SQL + ODDS_SQL + ODDS_ROWS + """, m AS (SELECT * FROM wide WHERE abs(delta) > 0.01), e AS (SELECT * FROM (SELECT * FROM m ORDER BY delta, fighter LIMIT 15) UNION SELECT * FROM (SELECT * FROM m ORDER BY delta DESC, fighter LIMIT 15))
SELECT e.fighter, round(e.delta, 6) AS delta, coalesce(fo.n_odds, 0) AS n_odds, round(fo.median_prob, 6) AS median_prob FROM e LEFT JOIN fo USING (fighter)""")
def moved_with_odds(spark, sf_dir):
    g = Given(spark, sf_dir)
    return boards.moved(_wide(g), g.odds, "delta").select("fighter", r("delta").alias("delta"), "n_odds", r("median_prob").alias("median_prob"))


@query(WIDE_SQL + " SELECT count(*) FILTER (abs(delta) > 0.01) AS moved, count(*) AS fighters FROM wide")
def moved_count(spark, sf_dir):
    return boards.moved_count(_wide(Given(spark, sf_dir)), "delta")


@query(WIDE_SQL + " SELECT * FROM (SELECT fighter, 'Current rating' AS metric, mu AS value FROM wide WHERE fighter = 'S1' UNION ALL SELECT fighter, '10-year peak', sustained_peak_headline_mu_whr FROM wide WHERE fighter = 'S1' UNION ALL SELECT fighter, '5-year peak', five_year_peak_headline_mu_whr FROM wide WHERE fighter = 'S1')")
def rating_profile(spark, sf_dir):
    return boards.profile(_wide(Given(spark, sf_dir)), "S1")


@query(WIDE_SQL + " SELECT fighter, mu FROM wide WHERE contains(lower(fighter), 's2')")
def fighters_by_text(spark, sf_dir):
    return boards.of_fighter(_wide(Given(spark, sf_dir)), "s-2").select("fighter", "mu")


@query(""" SELECT bout_id, CASE WHEN weight_class LIKE '%Women''s Flyweight%' THEN 'Women''s Flyweight' WHEN weight_class LIKE '%Welterweight%' THEN 'Welterweight' WHEN weight_class LIKE '%Lightweight%' THEN 'Lightweight'
  WHEN weight_class LIKE '%Heavyweight%' THEN 'Heavyweight' WHEN weight_class LIKE '%Flyweight%' THEN 'Flyweight' ELSE 'Catch Weight' END AS division FROM bouts""")
def chart_divisions(spark, sf_dir):
    return boards.with_division(Given(spark, sf_dir).bouts.drop("division")).select("bout_id", "division")


def _newest(oracle: str) -> str:
    return f"WITH en AS ({oracle}) SELECT * FROM en WHERE division IN (SELECT division FROM en WHERE year = (SELECT max(year) FROM en) ORDER BY top_mu_mean DESC, division LIMIT 3)"


@query(_newest(ORACLE["division_entropy"]), bouts=False)
def entropy_of_the_strongest(spark, sf_dir):
    return boards.entropy_lines(_entropy_query(spark, sf_dir), n=3)


@query(f"WITH st0 AS ({ORACLE['division_strength']}) SELECT division, strength, n FROM st0 WHERE year = 1996", bouts=False)
def strength_of_a_year(spark, sf_dir):
    return boards.strength_of_year(_strength_query(spark, sf_dir), 1996)


# ---- periods of any length


@query(PERIOD_SQL.format(days=3650, least=13, raw=10))
def best_period_ten_years(spark, sf_dir):
    return _period(spark, sf_dir, DEFAULT.ten_year)


@query(PERIOD_SQL.format(days=1096, least=8, raw=6))
def prime_of_three_years(spark, sf_dir):
    return _period(spark, sf_dir, labels.prime_spec(3))


@query(PERIOD_SQL.format(days=2557, least=12, raw=9))
def prime_of_seven_years(spark, sf_dir):
    return _period(spark, sf_dir, labels.prime_spec(7, 12))


# ---- other organisations

CROSS_SQL = CURRENT_SQL + """, kn AS (SELECT lower(fighter) AS name_key, fighter AS known, recent_division AS known_division FROM current),
rw AS (SELECT bout_id, 'k' || bout_id AS fight_key, 2 * bout_id + s.side AS ord, CASE s.side WHEN 0 THEN fighter_a ELSE fighter_b END AS f0, CASE s.side WHEN 0 THEN fighter_b ELSE fighter_a END AS o0, fighter_a,
    CASE WHEN is_draw THEN 'draw' WHEN bout_id % 9 = 0 AND s.side = 0 THEN 'nc' WHEN winner = CASE s.side WHEN 0 THEN fighter_a ELSE fighter_b END THEN 'win' ELSE 'loss' END AS result,
    event_date + INTERVAL 8 YEAR AS event_date, ['PRIDE', 'Strikeforce', 'WEC'][1 + bout_id % 3] AS org, method_class FROM bouts CROSS JOIN (VALUES (0), (1)) s(side)),
rn AS (SELECT *, CASE WHEN bout_id % 5 = 0 AND f0 = fighter_a THEN 'Guest ' || f0 WHEN bout_id % 10 = 0 THEN 'Guest ' || f0 ELSE lower(f0) END AS fighter, CASE WHEN bout_id % 5 = 0 AND o0 = fighter_a THEN 'Guest ' || o0 WHEN bout_id % 10 = 0 THEN 'Guest ' || o0 ELSE lower(o0) END AS opponent FROM rw),
rk AS (SELECT rn.*, kf.known AS nf, kf.known_division AS df, ko.known AS no, ko.known_division AS dop FROM rn LEFT JOIN kn kf ON kf.name_key = lower(replace(fighter, ' ', '')) LEFT JOIN kn ko ON ko.name_key = lower(replace(opponent, ' ', ''))
  WHERE event_date >= DATE '2000-11-17'),
rb AS (SELECT *, row_number() OVER (PARTITION BY fight_key ORDER BY result NOT IN ('win', 'loss'), ord) AS k FROM rk WHERE nf IS NOT NULL OR no IS NOT NULL),
cx AS (SELECT fight_key, CASE WHEN result = 'loss' THEN coalesce(no, opponent) ELSE coalesce(nf, fighter) END AS fighter_a, CASE WHEN result = 'loss' THEN coalesce(nf, fighter) ELSE coalesce(no, opponent) END AS fighter_b,
    CASE result WHEN 'win' THEN coalesce(nf, fighter) WHEN 'loss' THEN coalesce(no, opponent) END AS winner, result = 'draw' AS is_draw, result = 'nc' AS is_nc,
    coalesce(CASE WHEN result = 'loss' THEN dop ELSE df END, CASE WHEN result = 'loss' THEN df ELSE dop END, 'Open Weight') AS weight_class, org FROM rb WHERE k = 1)"""

CROSS_WEIGHT_SQL = CROSS_SQL + """, fl AS (SELECT mu FROM current WHERE rating_periods >= 3), ca AS (SELECT fighter, (SELECT count(*) FROM fl WHERE fl.mu < c.mu) / (SELECT count(*) FROM fl) AS pct FROM current c),
cs AS (SELECT fight_key, fighter_a AS fighter, fighter_b AS opponent FROM cx UNION ALL SELECT fight_key, fighter_b, fighter_a FROM cx),
ci AS (SELECT s.fighter, median(o.pct) AS pct FROM cs s LEFT JOIN ca m ON m.fighter = s.fighter LEFT JOIN ca o ON o.fighter = s.opponent WHERE m.pct IS NULL GROUP BY 1),
cw AS (SELECT s.fight_key, least(1.0, greatest(0.5, avg(coalesce(c.pct, i.pct, 0.3)))) AS org_weight FROM cs s LEFT JOIN ca c ON c.fighter = s.fighter LEFT JOIN ci i ON i.fighter = s.fighter GROUP BY 1)"""


def _raw_crossing(g: Given) -> DataFrame:
    """Both sides' rows of every bout, eight years later, in other organisations; some sides go by a name that nobody has, some rows show no contest."""
    c = F.col
    sides = F.array(*[F.struct(F.lit(i).alias("side"), c(f"fighter_{a}").alias("f0"), c(f"fighter_{b}").alias("o0")) for i, (a, b) in enumerate((("a", "b"), ("b", "a")))])
    rows = g.bouts.select("*", F.explode(sides).alias("s")).select("*", "s.*")

    def guest(name):
        return F.when((c("bout_id") % 10 == 0) | ((c("bout_id") % 5 == 0) & (name == c("fighter_a"))), F.concat(F.lit("Guest "), name)).otherwise(F.lower(name))

    result = F.when(c("is_draw"), "draw").when((c("bout_id") % 9 == 0) & (c("side") == 0), "nc").when(c("winner") == c("f0"), "win").otherwise("loss")
    org = F.element_at(F.array(*map(F.lit, ("PRIDE", "Strikeforce", "WEC"))), (1 + c("bout_id") % 3).cast("int"))
    return rows.select(
        F.concat(F.lit("k"), "bout_id").alias("fight_key"), (2 * c("bout_id") + c("side")).alias("ord"), guest(c("f0")).alias("fighter"), guest(c("o0")).alias("opponent"), result.alias("result"),
        F.concat(org, F.lit(" "), c("event_name")).alias("event_name"), F.add_months("event_date", 96).alias("event_date"), org.alias("org"), "method_class",
    )


@query(CROSS_SQL + " SELECT * FROM cx")
def crossing_bouts(spark, sf_dir):
    g = Given(spark, sf_dir)
    rows = crossing.canonical(_raw_crossing(g), crossing.known_names(g.current))
    return rows.select("fight_key", "fighter_a", "fighter_b", "winner", "is_draw", "is_nc", "weight_class", "org")


@query(CROSS_WEIGHT_SQL + " SELECT org, count(*) AS bouts, round(avg(org_weight), 3) AS mean_weight FROM cx JOIN cw USING (fight_key) GROUP BY org")
def crossing_summary(spark, sf_dir):
    g = Given(spark, sf_dir)
    return crossing.summary(crossing.weighted(crossing.canonical(_raw_crossing(g), crossing.known_names(g.current)), g.current))


@query(CROSS_WEIGHT_SQL + """, al AS (SELECT 1.0 AS w, fighter_a, fighter_b FROM bouts UNION ALL SELECT org_weight, fighter_a, fighter_b FROM cx JOIN cw USING (fight_key))
SELECT fighter, count(*) AS bouts, round(sum(w), 4) AS weight FROM (SELECT fighter_a AS fighter, w FROM al UNION ALL SELECT fighter_b, w FROM al) GROUP BY fighter""")
def joined_organisations(spark, sf_dir):
    g = Given(spark, sf_dir)
    rows = crossing.joined(g.bouts, crossing.weighted(crossing.canonical(_raw_crossing(g), crossing.known_names(g.current)), g.current))
    sides = rows.select(F.explode(F.array("fighter_a", "fighter_b")).alias("fighter"), "org_weight")
    return sides.groupBy("fighter").agg(F.count(F.lit(1)).alias("bouts"), r(F.sum("org_weight"), 4).alias("weight"))


@query(CURRENT_SQL + " SELECT lower(fighter) AS name_key, fighter AS known, recent_division AS known_division FROM current")
def known_names(spark, sf_dir):
    return crossing.known_names(Given(spark, sf_dir).current)


@query(CROSS_SQL + " SELECT DISTINCT nf AS fighter FROM rk JOIN bouts USING (bout_id) WHERE nf IS NOT NULL")
def crossing_roster(spark, sf_dir):
    g = Given(spark, sf_dir)
    late = _raw_crossing(g).where("event_date >= '2000-11-17'").select(F.col("event_name").alias("event"), F.col("fighter").alias("fighter_name"))
    return crossing.roster(late, crossing.known_names(g.current))


# ---- sheets


SHEET_SQL = WIDE_SQL + """, ta AS (SELECT fighter, recent_division AS division, rating_periods AS fights, mu + 1 AS score FROM wide ORDER BY mu DESC, fighter LIMIT 30), tb AS (SELECT fighter, recent_division AS division, rating_periods AS fights, mu_method AS score FROM wide ORDER BY mu_method DESC, fighter LIMIT 30)"""


def _sheets(g: Given) -> tuple[DataFrame, DataFrame, DataFrame]:
    wide = _wide(g)
    a = wide.orderBy(F.desc("mu"), "fighter").limit(30).select("fighter", F.col("recent_division").alias("division"), F.col("rating_periods").alias("fights"), (F.col("mu") + 1).alias("score"))
    b = wide.orderBy(F.desc("mu_method"), "fighter").limit(30).select("fighter", F.col("recent_division").alias("division"), F.col("rating_periods").alias("fights"), F.col("mu_method").alias("score"))
    return wide, a, b


@query(SHEET_SQL + """ SELECT fighter, coalesce(ta.division, tb.division) AS division, coalesce(ta.fights, tb.fights) AS fights, round(coalesce(ta.score, round(w.sustained_peak_headline_mu_whr, 1)), 4) AS whr, round(tb.score, 4) AS method,
  CASE WHEN ta.score IS NULL THEN 'whr' ELSE '' END AS filled FROM ta FULL JOIN tb USING (fighter) JOIN wide w USING (fighter)""")
def merged_metrics(spark, sf_dir):
    wide, a, b = _sheets(Given(spark, sf_dir))
    rows = boards.merged_metrics([(a, "score", "whr"), (b, "score", "method")], wide, {"whr": "whr", "method": "nothing"}, "sustained_peak_headline_mu_")
    return rows.select("fighter", "division", "fights", r("whr", 4).alias("whr"), r("method", 4).alias("method"), "filled")


@query(SHEET_SQL + " SELECT fighter, division, fights, round(score, 4) AS score FROM (SELECT * FROM ta UNION ALL SELECT * FROM tb)")
def stacked_tables(spark, sf_dir):
    _, a, b = _sheets(Given(spark, sf_dir))
    return boards.stacked([a, b]).withColumn("score", r("score", 4))


# ---- catalog


@query(""" SELECT 'supplier' AS table_name, column_name FROM (DESCRIBE SELECT * FROM supplier) UNION ALL SELECT 'nation', column_name FROM (DESCRIBE SELECT * FROM nation)""", bouts=False)
def listed_columns(spark, sf_dir):
    return catalog.columns_of({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("supplier", "nation")}).select("table_name", "column_name")


@query(""" SELECT CAST(0 AS BIGINT) AS n, 'bout_id,fighter_a,fighter_b,american_odds_a,american_odds_b,decimal_odds_a,decimal_odds_b,raw_a,raw_b,overround,odds_data_quality,prob_a,prob_b,favorite,underdog' AS columns""", bouts=False)
def empty_odds(spark, sf_dir):
    rows = raw.odds_lines(spark, f"{sf_dir}/none")
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(",".join(rows.columns)))
