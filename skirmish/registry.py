"""Registered queries: every operator on the sample tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import clean, names, odds as odds_fn, quality, ratings
from .operators import context, diagnostics, kernels, periods, reshape, weights
from .plans import library, snapshot
from .sources import adapters, catalog, raw
from .sources.adapters import BOUTS_SQL, ODDS_SQL
from .sources.staging import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, bouts: bool = True):
    """Register a function by its name; `sql` follows the bouts' head where `bouts` says so."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (BOUTS_SQL if bouts else "") + sql
        return f

    return put


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


class Given:
    """The derived inputs of one run."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        self.spark, self.dir, self.stored = spark, sf_dir, stored
        # used many times in a query: kept, and found again by the next one, as the plans are equal; or stored, so that the shuffle files behind them go
        self.bouts = adapters.sequenced(cut(adapters.bouts(spark, sf_dir), "bouts")) if stored else adapters.sequenced(adapters.bouts(spark, sf_dir)).persist()

    @property
    def apps(self) -> DataFrame:
        return reshape.appearances(self.bouts)

    @cached_property
    def history(self) -> DataFrame:
        rows = adapters.surrogate_history(self.apps)
        return cut(rows, "history") if self.stored else rows.persist()

    @property
    def odds(self) -> DataFrame:
        return odds_fn.enriched(adapters.odds(self.spark, self.dir, self.bouts))

    @property
    def rounds(self) -> DataFrame:
        return adapters.rounds(self.spark, self.dir)

    @property
    def full(self) -> DataFrame:
        """Bouts with titles, ranks and scores."""
        ranked = cut(context.ranks(self.bouts, self.apps, self.history), "ranks")
        rows = weights.scored(context.with_ranks(context.title_lineage(self.bouts), ranked))
        return cut(rows.drop("weight_class", "time_format", "details_text", "loser", "end_round", "end_time_seconds", "qty_a", "qty_b", *weights.FLAGS, "champion", "interim_champion"), "bouts")

    @property
    def current(self) -> DataFrame:
        rows = self.history.groupBy("fighter").agg(F.max_by("mu", "event_seq").alias("mu"), F.count(F.lit(1)).alias("rating_periods"), F.max("event_date").alias("last_event_date"))
        return rows.join(snapshot.recent_divisions(self.bouts), "fighter").withColumn("phi", 60 + F.col("rating_periods") % 90)

    @property
    def quality(self) -> DataFrame:
        return weights.appearance_quality(self.full, context.prefight(self.history))


CURRENT_SQL = """, recent AS (
  SELECT fighter, arg_max(division, (event_seq, bout_id)) AS recent_division FROM apps GROUP BY fighter
), current AS (
  SELECT h.fighter, arg_max(h.mu, h.event_seq) AS mu, count(*) AS rating_periods, max(h.event_date) AS last_event_date, any_value(r.recent_division) AS recent_division,
    60 + count(*) % 90 AS phi FROM history h JOIN recent r USING (fighter) GROUP BY h.fighter
)"""

RANKS_SQL = """, days AS (SELECT DISTINCT event_seq, event_date FROM bouts JOIN seqs USING (event_date, event_name)),
lastdiv AS (SELECT fighter, event_seq, arg_max(division, bout_id) AS division FROM apps GROUP BY fighter, event_seq),
states AS (
  SELECT h.fighter, d.division, h.mu, h.event_seq AS s0, h.event_date AS d0, lead(h.event_seq) OVER (PARTITION BY h.fighter ORDER BY h.event_seq) AS s1
  FROM history h JOIN lastdiv d USING (fighter, event_seq)
), ranked AS (
  SELECT e.event_seq, s.fighter, s.division AS ranked_division, row_number() OVER (PARTITION BY e.event_seq ORDER BY s.mu DESC, s.fighter) AS p4p_rank,
    row_number() OVER (PARTITION BY e.event_seq, s.division ORDER BY s.mu DESC, s.fighter) AS division_rank
  FROM days e JOIN states s ON s.s0 < e.event_seq AND (s.s1 IS NULL OR e.event_seq <= s.s1) AND date_diff('day', s.d0, e.event_date) <= 1095
), titles AS (
  SELECT b.division, e.event_seq, b.bout_id, b.winner, b.is_interim FROM bouts b JOIN seqs e USING (event_date, event_name) WHERE b.is_title AND b.winner IS NOT NULL
), held AS (
  SELECT x.division, x.event_seq,
    (SELECT arg_max(t.winner, (t.event_seq, t.bout_id)) FROM titles t WHERE t.division = x.division AND NOT t.is_interim AND t.event_seq < x.event_seq) AS champion,
    (SELECT max((t.event_seq, t.bout_id)) FROM titles t WHERE t.division = x.division AND NOT t.is_interim AND t.event_seq < x.event_seq) AS at_full,
    (SELECT arg_max(t.winner, (t.event_seq, t.bout_id)) FROM titles t WHERE t.division = x.division AND t.is_interim AND t.event_seq < x.event_seq) AS interim,
    (SELECT max((t.event_seq, t.bout_id)) FROM titles t WHERE t.division = x.division AND t.is_interim AND t.event_seq < x.event_seq) AS at_interim
  FROM (SELECT DISTINCT division, event_seq FROM apps) x
), lined AS (
  SELECT b.*, e.event_seq, coalesce(b.fighter_a = h.champion, false) AS champ_a, coalesce(b.fighter_b = h.champion, false) AS champ_b,
    coalesce(b.fighter_a = i.who, false) AS interim_a, coalesce(b.fighter_b = i.who, false) AS interim_b,
    ra.p4p_rank AS p4p_a, rb.p4p_rank AS p4p_b, CASE WHEN ra.ranked_division = b.division THEN ra.division_rank END AS rank_a,
    CASE WHEN rb.ranked_division = b.division THEN rb.division_rank END AS rank_b
  FROM bouts b JOIN seqs e USING (event_date, event_name) LEFT JOIN held h ON h.division = b.division AND h.event_seq = e.event_seq
  LEFT JOIN (SELECT division, event_seq, CASE WHEN at_full IS NULL OR at_interim > at_full THEN interim END AS who FROM held) i ON i.division = b.division AND i.event_seq = e.event_seq
  LEFT JOIN ranked ra ON ra.event_seq = e.event_seq AND ra.fighter = b.fighter_a LEFT JOIN ranked rb ON rb.event_seq = e.event_seq AND rb.fighter = b.fighter_b
)"""

SCORED_SQL = """, pref AS (SELECT *, coalesce(lag(mu) OVER (PARTITION BY fighter ORDER BY event_seq), 1500) AS prefight_mu FROM history),
scores AS (
  SELECT bout_id, CASE WHEN is_draw THEN NULL ELSE least(
      CASE WHEN method_class IN ('KO/TKO', 'Submission') THEN 1.0 WHEN method_class = 'DQ' THEN 0.85 WHEN method_class = 'Decision - Unanimous' THEN
        CASE WHEN time_format LIKE '5%' AND winner = fighter_a AND CAST(substr(fighter_a, 2) AS INTEGER) % 4 = 0 THEN 0.97 ELSE 0.95 END ELSE 0.90 END,
      CASE WHEN ped_confirmed AND ped_flagged_fighter = winner THEN 0.55 ELSE 1 END, CASE WHEN missed_weight AND missed_weight_fighter = winner THEN 0.70 ELSE 1 END,
      CASE WHEN method_class = 'DQ' THEN 0.75 ELSE 1 END) END AS quality_score,
    CASE WHEN method_class = 'DQ' THEN 0.70 WHEN method_class IN ('KO/TKO', 'Submission') THEN CASE WHEN end_round <= 1 THEN 1.0 ELSE 0.95 END
      WHEN method_class = 'Decision - Split' THEN 0.78 WHEN method_class = 'Decision - Majority' THEN 0.80 ELSE 0.83 END AS decisiveness,
    CASE WHEN (greatest(end_round, 1) - 1) * 300 + end_time_seconds > 0 THEN (greatest(end_round, 1) - 1) * 300 + end_time_seconds END AS bout_seconds,
    CASE WHEN time_format LIKE '5%' THEN 5 ELSE 3 END AS scheduled_rounds
  FROM bouts
)"""

QUALITY_SQL = RANKS_SQL + SCORED_SQL + """, sides AS (
  SELECT bout_id, event_seq, event_date, event_name, 'a' AS side, fighter_a AS fighter, fighter_b AS opponent, winner, is_draw, division, is_title, is_interim, rank_b AS opp_rank, p4p_b AS opp_p4p,
    champ_b AS opp_champ, interim_b AS opp_interim, champ_a AS champ, interim_a AS interim, rank_a AS own_rank, p4p_a AS own_p4p FROM lined
  UNION ALL SELECT bout_id, event_seq, event_date, event_name, 'b', fighter_b, fighter_a, winner, is_draw, division, is_title, is_interim, rank_a, p4p_a, champ_a, interim_a, champ_b, interim_b, rank_b, p4p_b FROM lined
), leveled AS (
  SELECT s.*, coalesce(p.prefight_mu, 1500) AS opp_mu, CASE WHEN s.is_draw THEN 0.5 WHEN s.winner = s.fighter THEN 1.0 ELSE 0.0 END AS actual_score,
    CASE WHEN opp_rank BETWEEN 1 AND 15 THEN (16 - opp_rank) / 15.0 ELSE 0 END AS rank_only,
    CASE WHEN opp_p4p BETWEEN 1 AND 15 THEN (16 - opp_p4p) / 15.0 ELSE 0 END AS p4p_level,
    CASE WHEN opp_champ THEN 1.0 WHEN opp_interim THEN 0.85 ELSE 0 END AS holder,
    CASE WHEN opp_champ THEN 1.0 WHEN opp_interim THEN 0.80 WHEN is_interim THEN 0.55 WHEN is_title THEN 0.65 ELSE 0 END AS title_level,
    least(1.0, greatest(0.0, (coalesce(p.prefight_mu, 1500) - 1500) / 900)) AS mu_level
  FROM sides s LEFT JOIN pref p ON p.fighter = s.opponent AND p.event_seq = s.event_seq
), quality AS (
  SELECT *, greatest(mu_level, rank_only, holder, p4p_level, title_level) AS quality_level,
    2.6 * least(1.0, greatest(0.0, (1 / (1 + exp(-(greatest(mu_level, rank_only, holder, p4p_level, title_level) - 0.5) / 0.22)) - 1 / (1 + exp(0.5 / 0.22)))
      / (1 / (1 + exp(-0.5 / 0.22)) - 1 / (1 + exp(0.5 / 0.22))))) * CASE WHEN is_title OR is_interim THEN 1.4 ELSE 1 END AS opp_weight FROM leveled
), valued AS (
  SELECT *, CASE WHEN actual_score >= 1 THEN 0.25 + opp_weight WHEN actual_score > 0 THEN 0.25 + 0.5 * opp_weight ELSE 0.5 + (1 - quality_level) END AS period_weight,
    CASE WHEN actual_score >= 1 THEN 10 WHEN actual_score = 0.5 THEN -5 ELSE -55 END + CASE WHEN is_title THEN 8 ELSE 0 END + CASE WHEN actual_score >= 1 THEN greatest(
      CASE WHEN is_title THEN 55 ELSE 0 END, CASE WHEN is_interim THEN 35 ELSE 0 END, CASE WHEN opp_champ THEN 35 ELSE 0 END, CASE WHEN opp_interim THEN 20 ELSE 0 END,
      CASE WHEN opp_rank BETWEEN 1 AND 5 THEN 25 WHEN opp_rank BETWEEN 6 AND 10 THEN 15 WHEN opp_rank BETWEEN 11 AND 15 THEN 8 ELSE 0 END,
      CASE WHEN opp_p4p BETWEEN 1 AND 5 THEN 25 WHEN opp_p4p BETWEEN 6 AND 15 THEN 10 ELSE 0 END) ELSE 0 END AS adjustment,
    CAST(is_title OR is_interim AS INTEGER) AS t_bout, CAST((is_title OR is_interim) AND actual_score >= 1 AS INTEGER) AS t_win,
    CAST((is_title OR is_interim) AND actual_score >= 1 AND (champ OR interim) AS INTEGER) AS t_defense
  FROM quality
)"""


# ---- bouts and appearances


@query(" SELECT bout_id, CAST(event_date AS VARCHAR) AS event_date, fighter_a, fighter_b, winner, is_draw, division, weight_class, method_class, end_round, end_time_seconds FROM bouts")
def bouts(spark, sf_dir):
    g = Given(spark, sf_dir)
    return g.bouts.select("bout_id", F.col("event_date").cast("string").alias("event_date"), "fighter_a", "fighter_b", "winner", "is_draw", "division", "weight_class", "method_class", "end_round", "end_time_seconds")


@query(" SELECT bout_id, event_seq, side, fighter, opponent, is_winner, CASE WHEN is_draw THEN 0.5::DOUBLE WHEN is_winner THEN 1.0 ELSE 0.0 END AS actual_score FROM apps")
def appearances(spark, sf_dir):
    return Given(spark, sf_dir).apps.select("bout_id", F.col("event_seq").cast("long").alias("event_seq"), "side", "fighter", "opponent", "is_winner", "actual_score")


RECORDS_SQL = """ SELECT fighter, count(*) FILTER (is_winner) AS wins, count(*) FILTER (NOT is_winner AND NOT is_draw) AS losses, count(*) FILTER (is_draw) AS draws, count(*) AS total FROM apps GROUP BY fighter"""


@query(RECORDS_SQL)
def career_records(spark, sf_dir):
    return library.records(Given(spark, sf_dir).apps).drop("win_methods")


@query(""", c AS (SELECT fighter, method_class, count(*) AS n FROM apps WHERE is_winner GROUP BY 1, 2)
SELECT fighter, string_agg(method_class || ': ' || n, ', ' ORDER BY method_class || ': ' || n) AS win_methods FROM c GROUP BY fighter""")
def win_methods(spark, sf_dir):
    return library.records(Given(spark, sf_dir).apps).where("win_methods is not null").select("fighter", "win_methods")


@query(f""", rec AS ({RECORDS_SQL}), k AS (SELECT fighter, wins, losses, draws, rank() OVER (ORDER BY wins DESC) AS rank FROM rec)
SELECT * FROM k ORDER BY rank, fighter LIMIT 25""")
def leaderboard_wins(spark, sf_dir):
    rows = library.records(Given(spark, sf_dir).apps).withColumn("rating_periods", F.col("total"))
    return library.ranked(rows, "wins", least=0).select("fighter", "wins", "losses", "draws", F.col("rank").cast("long").alias("rank")).orderBy("rank", "fighter").limit(25)


# ---- scores, odds, integrity, dominance


@query(SCORED_SQL + " SELECT bout_id, round(quality_score, 6) AS quality_score, round(decisiveness, 6) AS decisiveness, bout_seconds, scheduled_rounds FROM scores")
def bout_scores(spark, sf_dir):
    return weights.scored(Given(spark, sf_dir).bouts).select("bout_id", r("quality_score"), r("decisiveness").alias("decisiveness"), "bout_seconds", "scheduled_rounds").withColumnRenamed("round(quality_score, 6)", "quality_score")


INTEGRITY_SQL = """, integ AS (SELECT a.bout_id, a.fighter,
  CASE WHEN is_winner AND b.ped_confirmed AND b.ped_flagged_fighter = a.fighter THEN 0.80 ELSE 1.0 END AS f1, CASE WHEN is_winner AND a.method_class = 'DQ' THEN 0.92 ELSE 1.0 END AS f2,
  CASE WHEN is_winner AND b.missed_weight AND b.missed_weight_fighter = a.fighter THEN 0.88 ELSE 1.0 END AS f3 FROM apps a JOIN bouts b USING (bout_id))"""


@query(INTEGRITY_SQL + " SELECT bout_id, fighter, f1::DOUBLE AS integrity_factor_ped, f2::DOUBLE AS integrity_factor_dq, f3::DOUBLE AS integrity_factor_missed_weight, round(greatest(0.8, f1::DOUBLE * f2 * f3), 6) AS integrity_weight FROM integ")
def integrity_appearances(spark, sf_dir):
    return weights.integrity_appearances(Given(spark, sf_dir).bouts).withColumn("integrity_weight", r("integrity_weight"))


@query(ODDS_SQL + """ SELECT bout_id, round(raw_a, 6) AS raw_a, round(raw_b, 6) AS raw_b, odds_data_quality, round(prob_a, 6) AS prob_a, round(prob_b, 6) AS prob_b,
  CASE WHEN prob_a > prob_b THEN fighter_a WHEN prob_b > prob_a THEN fighter_b END AS favorite, CASE WHEN prob_a > prob_b THEN fighter_b WHEN prob_b > prob_a THEN fighter_a END AS underdog FROM lines_ok""")
def odds_enriched(spark, sf_dir):
    return Given(spark, sf_dir).odds.select("bout_id", *[r(c).alias(c) for c in ("raw_a", "raw_b")], "odds_data_quality", *[r(c).alias(c) for c in ("prob_a", "prob_b")], "favorite", "underdog")


@query(ODDS_SQL + """ SELECT bout_id, round(CASE WHEN american_odds_a > 0 THEN 1 + american_odds_a / 100 WHEN american_odds_a < 0 THEN 1 - 100 / american_odds_a END, 6) AS decimal_a,
  round(CASE WHEN decimal_odds_b >= 2 THEN (decimal_odds_b - 1) * 100 WHEN decimal_odds_b > 1 THEN -100 / (decimal_odds_b - 1) END, 4) AS american_b FROM odds""")
def odds_conversions(spark, sf_dir):
    g = Given(spark, sf_dir)
    return adapters.odds(spark, sf_dir, g.bouts).select("bout_id", r(odds_fn.american_to_decimal(F.col("american_odds_a"))).alias("decimal_a"), r(odds_fn.decimal_to_american(F.col("decimal_odds_b")), 4).alias("american_b"))


FAVOURITES_SQL = ODDS_SQL + """, s AS (SELECT winner, is_draw, 'favorite' AS side, CASE WHEN prob_a > prob_b THEN fighter_a ELSE fighter_b END AS who, greatest(prob_a, prob_b) AS p FROM lines_ok WHERE odds_data_quality = 'ok' AND prob_a <> prob_b
  UNION ALL SELECT winner, is_draw, 'underdog', CASE WHEN prob_a > prob_b THEN fighter_b ELSE fighter_a END, 1 - greatest(prob_a, prob_b) FROM lines_ok WHERE odds_data_quality = 'ok' AND prob_a <> prob_b)
SELECT side, count(*) AS bouts, count(*) FILTER (winner = who AND NOT is_draw) AS wins, count(*) FILTER (is_draw) AS draws, round(avg(p), 6) AS expected,
  round(count(*) FILTER (winner = who AND NOT is_draw) / (count(*) - count(*) FILTER (is_draw)), 6) AS win_rate FROM s GROUP BY side"""


@query(FAVOURITES_SQL)
def favourite_performance(spark, sf_dir):
    return library.favourite_table(Given(spark, sf_dir).odds).select("side", "bouts", "wins", "draws", r("expected").alias("expected"), r("win_rate").alias("win_rate"))


@query(ODDS_SQL + """ SELECT fighter, count(p) AS n_odds, round(median(p), 6) AS median_prob FROM (SELECT fighter_a AS fighter, prob_a AS p FROM lines_ok WHERE odds_data_quality = 'ok'
  UNION ALL SELECT fighter_b, prob_b FROM lines_ok WHERE odds_data_quality = 'ok') GROUP BY fighter""")
def fighter_odds_profile(spark, sf_dir):
    return library.fighter_odds(Given(spark, sf_dir).odds).withColumn("median_prob", r("median_prob"))


DOMINANCE_SQL = """, stat AS (SELECT l_orderkey AS bout_id, 'S' || l_suppkey AS fighter, sum(l_quantity) AS q, sum(round(l_discount * 100, 0)) AS d, sum(round(l_tax * 1000, 0)) AS t FROM lineitem GROUP BY 1, 2),
diffs AS (SELECT b.bout_id, b.winner, b.fighter_a, b.fighter_b, x.q - y.q AS q, x.d - y.d AS d, x.t - y.t AS t FROM bouts b JOIN stat x ON x.bout_id = b.bout_id AND x.fighter = b.fighter_a JOIN stat y ON y.bout_id = b.bout_id AND y.fighter = b.fighter_b),
dom AS (SELECT *, (q - avg(q) OVER ()) / stddev_pop(q) OVER () AS zq, (d - avg(d) OVER ()) / stddev_pop(d) OVER () AS zd, (t - avg(t) OVER ()) / stddev_pop(t) OVER () AS zt FROM diffs)"""


@query(DOMINANCE_SQL + " SELECT bout_id, q AS sig_str_landed_diff, d AS sub_att_diff, t AS ctrl_seconds_diff, round(zq + zd + zt, 6) AS dominance_a FROM dom")
def bout_dominance(spark, sf_dir):
    g = Given(spark, sf_dir)
    return weights.bout_dominance(g.rounds, g.bouts).select("bout_id", "sig_str_landed_diff", "sub_att_diff", "ctrl_seconds_diff", r("dominance_a").alias("dominance_a"))


@query(DOMINANCE_SQL + " SELECT winner AS fighter, count(*) AS wins, round(avg(CASE WHEN winner = fighter_a THEN zq + zd + zt ELSE -(zq + zd + zt) END), 6) AS mean_dominance FROM dom WHERE winner IS NOT NULL GROUP BY winner")
def competitor_dominance(spark, sf_dir):
    g = Given(spark, sf_dir)
    return weights.competitor_dominance(weights.bout_dominance(g.rounds, g.bouts), g.bouts).withColumn("mean_dominance", r("mean_dominance"))


# ---- ordered context


@query(" SELECT fighter, event_seq, mu, coalesce(lag(mu) OVER w, 1500) AS prefight_mu, row_number() OVER w - 1 AS prior_events, mu - coalesce(lag(mu) OVER w, 1500) AS delta FROM history WINDOW w AS (PARTITION BY fighter ORDER BY event_seq)")
def prefight_ratings(spark, sf_dir):
    rows = context.deltas(context.prefight(Given(spark, sf_dir).history))
    return rows.select("fighter", F.col("event_seq").cast("long").alias("event_seq"), "mu", "prefight_mu", F.col("prior_events").cast("long").alias("prior_events"), "delta")


@query(""", g AS (SELECT *, date_diff('day', lag(event_date) OVER (PARTITION BY fighter ORDER BY event_date, event_name, bout_id), event_date) AS days FROM apps)
SELECT bout_id, fighter, days AS activity_gap_days, round(coalesce(least(1.0, greatest(0.0, (days - 270) / 460.0)), 0), 6) AS layoff_level FROM g""")
def activity_gaps(spark, sf_dir):
    rows = context.layoffs(Given(spark, sf_dir).apps)
    return rows.select("bout_id", "fighter", F.col("activity_gap_days").cast("long").alias("activity_gap_days"), r(quality.layoff_level(F.col("activity_gap_days"))).alias("layoff_level"))


STREAKS_SQL = """, w4 AS (SELECT *, sum(CASE WHEN is_winner THEN 0 ELSE 1 END) OVER (PARTITION BY fighter ORDER BY event_seq, bout_id) AS isl FROM apps),
w5 AS (SELECT *, sum(CASE WHEN is_winner THEN 1 ELSE 0 END) OVER (PARTITION BY fighter, isl ORDER BY event_seq, bout_id) AS run FROM w4),
w6 AS (SELECT fighter, event_seq, arg_max(run, bout_id) AS after FROM w5 GROUP BY 1, 2),
entering AS (SELECT fighter, event_seq, coalesce(lag(after) OVER (PARTITION BY fighter ORDER BY event_seq), 0) AS streak FROM w6)"""


@query(STREAKS_SQL + " SELECT a.bout_id, a.fighter, CAST(e.streak AS BIGINT) AS streak FROM apps a JOIN entering e USING (fighter, event_seq)")
def entering_streaks(spark, sf_dir):
    return context.win_streaks(Given(spark, sf_dir).apps).select("bout_id", "fighter", F.col("streak").cast("long").alias("streak"))


MOVES_SQL = """, lim(division, lb) AS (VALUES ('Lightweight', 155), ('Welterweight', 170), ('Women''s Flyweight', 125), ('Heavyweight', 265), ('Flyweight', 125)),
pe AS (SELECT fighter, event_seq, arg_max(division, bout_id) FILTER (division <> 'Catch Weight') AS d FROM apps GROUP BY 1, 2),
pv AS (SELECT fighter, event_seq, last_value(d IGNORE NULLS) OVER (PARTITION BY fighter ORDER BY event_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_division FROM pe),
moves AS (SELECT a.bout_id, a.fighter, p.previous_division, h.lb AS here, q.lb AS before, CASE WHEN h.lb IS NULL OR q.lb IS NULL THEN 'unknown' WHEN h.lb > q.lb THEN 'up' WHEN h.lb < q.lb THEN 'down' ELSE 'same' END AS move
  FROM apps a JOIN pv p USING (fighter, event_seq) LEFT JOIN lim h ON h.division = a.division LEFT JOIN lim q ON q.division = p.previous_division)"""


@query(MOVES_SQL + " SELECT bout_id, fighter, previous_division, move, move IN ('up', 'down') AS change_fight FROM moves")
def weight_class_moves(spark, sf_dir):
    return context.class_moves(Given(spark, sf_dir).apps).select("bout_id", "fighter", "previous_division", "move", "change_fight")


@query(RANKS_SQL + " SELECT bout_id, champ_a, champ_b, interim_a, interim_b FROM lined")
def title_lineage(spark, sf_dir):
    rows = context.title_lineage(Given(spark, sf_dir).bouts)
    return rows.select("bout_id", *[F.col(f"entered_{k}_{s}").alias(f"{n}_{s}") for k, n in (("champion", "champ"), ("interim", "interim")) for s in "ab"])


@query(RANKS_SQL + " SELECT bout_id, rank_a, rank_b, p4p_a, p4p_b FROM lined")
def prefight_ranks(spark, sf_dir):
    g = Given(spark, sf_dir)
    rows = context.with_ranks(g.bouts, context.ranks(g.bouts, g.apps, g.history))
    return rows.select("bout_id", *[F.col(f"{k}_rank_{s}").cast("long").alias(f"{n}_{s}") for k, n in (("division", "rank"), ("p4p", "p4p")) for s in "ab"])


ISLANDS_SQL = """, o AS (SELECT *, CASE WHEN is_draw THEN 'draw' WHEN is_winner THEN 'win' ELSE 'loss' END AS outcome FROM apps),
i AS (SELECT *, sum(CASE WHEN outcome = 'win' THEN 0 ELSE 1 END) OVER (PARTITION BY fighter ORDER BY event_date, event_name, bout_id) AS isl FROM o),
br AS (SELECT fighter, isl - 1 AS isl, outcome FROM i WHERE outcome <> 'win'),
md AS (SELECT fighter, isl, arg_min(division, (-n, division)) AS division FROM (SELECT fighter, isl, division, count(*) AS n FROM i WHERE outcome = 'win' GROUP BY 1, 2, 3) GROUP BY 1, 2),
wn AS (SELECT fighter, isl, count(*) AS length, min(event_date) AS s, max(event_date) AS e, string_agg(opponent, ', ' ORDER BY event_date, event_name, bout_id) AS opponents,
  count(*) FILTER (is_title) AS title_wins, count(*) FILTER (method_class IN ('KO/TKO', 'Submission')) AS finishes FROM i WHERE outcome = 'win' GROUP BY 1, 2 HAVING count(*) >= 2),
streaks AS (SELECT wn.fighter, length, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date, opponents, md.division, title_wins, finishes, br.outcome AS ended_by, br.outcome IS NULL AS ongoing
  FROM wn JOIN md USING (fighter, isl) LEFT JOIN br USING (fighter, isl))"""


@query(ISLANDS_SQL + " SELECT * FROM streaks")
def win_streaks(spark, sf_dir):
    rows = context.all_streaks(Given(spark, sf_dir).apps)
    return rows.withColumns({"start_date": F.col("start_date").cast("string"), "end_date": F.col("end_date").cast("string")})


@query(ISLANDS_SQL + " SELECT fighter, length, start_date, division, title_wins FROM streaks WHERE length >= 3 ORDER BY length DESC, title_wins DESC, fighter, start_date LIMIT 25")
def streak_table(spark, sf_dir):
    rows = context.all_streaks(Given(spark, sf_dir).apps, 3).withColumn("start_date", F.col("start_date").cast("string"))
    return rows.select("fighter", "length", "start_date", "division", "title_wins").orderBy(F.desc("length"), F.desc("title_wins"), "fighter", "start_date").limit(25)


# ---- weights and quality


@query(QUALITY_SQL + " SELECT bout_id, fighter, round(quality_level, 6) AS quality_level, round(opp_weight, 6) AS opp_weight, round(period_weight, 6) AS period_weight, adjustment::DOUBLE AS adjustment, t_bout, t_win, t_defense FROM valued")
def appearance_quality(spark, sf_dir):
    return Given(spark, sf_dir).quality.select("bout_id", "fighter", *[r(c).alias(c) for c in ("quality_level", "opp_weight", "period_weight", "adjustment")], "t_bout", "t_win", "t_defense")


PERFORMANCE_SQL = QUALITY_SQL + ODDS_SQL + STREAKS_SQL + MOVES_SQL + """, lines2 AS (
  SELECT bout_id, fighter_a AS fighter, coalesce(american_odds_a, CASE WHEN decimal_odds_a >= 2 THEN (decimal_odds_a - 1) * 100 WHEN decimal_odds_a > 1 THEN -100 / (decimal_odds_a - 1) END) AS american FROM lines_ok WHERE odds_data_quality = 'ok'
  UNION ALL SELECT bout_id, fighter_b, coalesce(american_odds_b, CASE WHEN decimal_odds_b >= 2 THEN (decimal_odds_b - 1) * 100 WHEN decimal_odds_b > 1 THEN -100 / (decimal_odds_b - 1) END) FROM lines_ok WHERE odds_data_quality = 'ok'
), gaps2 AS (SELECT bout_id, fighter, date_diff('day', lag(event_date) OVER (PARTITION BY fighter ORDER BY event_date, event_name, bout_id), event_date) AS days FROM apps),
f0 AS (
  SELECT v.*, v.actual_score >= 1 AS won, m.move, m.move IN ('up', 'down') AS changed, es.streak AS opp_streak, l.american, sc.decisiveness,
    coalesce(least(1.0, greatest(0.0, (g.days - 270) / 460.0)), 0) AS layoff,
    CASE WHEN champ THEN 0.0 WHEN interim THEN 1.0 ELSE least(coalesce(own_rank, 16), 16) END - CASE WHEN opp_champ THEN 0.0 WHEN opp_interim THEN 1.0 ELSE least(coalesce(opp_rank, 16), 16) END AS gap
  FROM valued v JOIN moves m ON m.bout_id = v.bout_id AND m.fighter = v.fighter JOIN entering es ON es.fighter = v.opponent AND es.event_seq = v.event_seq
  JOIN scores sc ON sc.bout_id = v.bout_id JOIN gaps2 g ON g.bout_id = v.bout_id AND g.fighter = v.fighter LEFT JOIN lines2 l ON l.bout_id = v.bout_id AND l.fighter = v.fighter
), f1 AS (
  SELECT *, 1 + 0.03 * decisiveness AS f_decisiveness, 1 + 0.16 * mu_level AS f_strength, 1 + 0.05 * least(opp_streak, 5) / 5.0 * (0.5 + 0.5 * least(1.0, greatest(0.0, (opp_mu - 1500) / 650))) AS f_streak,
    1 + 0.16 * greatest(rank_only, holder) AS f_rank, 1 + 0.16 * title_level AS f_title, 1 + 0.14 * p4p_level AS f_p4p,
    CASE WHEN NOT changed THEN 1.0 WHEN won AND move = 'up' THEN 1.05 WHEN NOT won AND NOT is_draw AND move = 'down' THEN 1.05 WHEN NOT won AND NOT is_draw AND move = 'up' THEN 0.9 ELSE 1.0 END AS f_class,
    CASE WHEN NOT won AND NOT is_draw THEN 1 + 0.12 * layoff ELSE 1.0 END AS f_layoff,
    1 + 0.03 * CASE WHEN won AND gap >= 6 THEN greatest(least(1.0, greatest(0.0, (gap - 6) / 10.0)), CASE WHEN american > 0 THEN least(1.0, greatest(0.0, (american - 250) / 450)) ELSE 0 END) ELSE 0 END AS f_upset,
    CASE WHEN american > 0 THEN 1 + 0.15 * american / max(american) FILTER (american > 0) OVER () WHEN american < 0 THEN 1 - 0.10 * -american / max(-american) FILTER (american < 0) OVER () ELSE 1.0 END AS f_odds FROM f0
), f2 AS (SELECT *, ln(f_decisiveness) + ln(greatest(f_strength, f_rank, f_title, f_p4p)) + ln(f_upset) + ln(f_streak) + ln(f_class) AS signal FROM f1),
f3 AS (SELECT *, 0.2 * tanh(coalesce(max(CASE WHEN won THEN signal END) OVER (PARTITION BY bout_id), 0) / 0.2) AS swing,
  CASE WHEN changed AND move = 'down' THEN f_class ELSE 1 END * CASE WHEN f_layoff > 1 THEN f_layoff ELSE 1 END AS harder FROM f2),
perf AS (SELECT *, least(1.2, greatest(0.8, CASE WHEN is_draw THEN 1 WHEN won THEN 1 + swing ELSE CASE WHEN harder > 1 THEN harder ELSE 1 - swing END * CASE WHEN changed AND move = 'up' THEN f_class ELSE 1 END END)) AS performance_weight FROM f3)"""


def _performance(g: Given) -> DataFrame:
    return weights.performance_appearances(g.full, context.prefight(g.history), g.odds)


FACTORS = ("f_decisiveness", "f_strength", "f_streak", "f_odds", "f_rank", "f_title", "f_p4p", "f_class", "f_layoff", "f_upset")


@query(PERFORMANCE_SQL + " SELECT bout_id, fighter, " + ", ".join(f"round({f}, 6) AS {f}" for f in FACTORS) + ", round(signal, 6) AS signal, round(performance_weight, 6) AS performance_weight FROM perf")
def performance_appearances(spark, sf_dir):
    return _performance(Given(spark, sf_dir)).select("bout_id", "fighter", *[r(c).alias(c) for c in (*FACTORS, "signal", "performance_weight")])


@query(PERFORMANCE_SQL + INTEGRITY_SQL + " SELECT p.bout_id, p.fighter, round(least(1.2, greatest(0.8, performance_weight * greatest(0.8, f1::DOUBLE * f2 * f3))), 6) AS combined_weight FROM perf p JOIN integ i ON i.bout_id = p.bout_id AND i.fighter = p.fighter")
def combined_weights(spark, sf_dir):
    g = Given(spark, sf_dir, stored=True)
    return weights.combined(weights.integrity_appearances(g.bouts), _performance(g)).select("bout_id", "fighter", r("combined_weight").alias("combined_weight"))


@query(INTEGRITY_SQL + """ SELECT b.bout_id, round(greatest(0.8, x.f1::DOUBLE * x.f2 * x.f3), 6) AS weight_a, round(greatest(0.8, y.f1::DOUBLE * y.f2 * y.f3), 6) AS weight_b
FROM bouts b JOIN integ x ON x.bout_id = b.bout_id AND x.fighter = b.fighter_a JOIN integ y ON y.bout_id = b.bout_id AND y.fighter = b.fighter_b""")
def bout_weights(spark, sf_dir):
    g = Given(spark, sf_dir)
    return reshape.weights_to_bouts(g.bouts, weights.integrity_appearances(g.bouts), "integrity_weight").select("bout_id", r("weight_a").alias("weight_a"), r("weight_b").alias("weight_b"))


LABELS = {"integrity_factor_ped": "finding", "integrity_factor_dq": "disqualification", "integrity_factor_missed_weight": "weight"}


@query(INTEGRITY_SQL + """, long AS (SELECT 'finding' AS factor, f1::DOUBLE AS m FROM integ UNION ALL SELECT 'disqualification', f2 FROM integ UNION ALL SELECT 'weight', f3 FROM integ)
SELECT factor, CASE WHEN m > 1.0001 THEN 'boost' WHEN m < 0.9999 THEN 'penalty' ELSE 'neutral' END AS effect, count(*) AS n, min(m) AS least, median(m) AS median, max(m) AS most FROM long GROUP BY 1, 2""")
def factor_summary(spark, sf_dir):
    return library.factor_summary(reshape.long_factors(weights.integrity_appearances(Given(spark, sf_dir).bouts), LABELS, ["bout_id", "fighter"]))


@query(INTEGRITY_SQL + """ SELECT bout_id, fighter, round(f1::DOUBLE * f2 * f3, 6) AS total, concat_ws(', ', CASE WHEN f2 < 1 THEN 'disqualification' END, CASE WHEN f1 < 1 THEN 'finding' END, CASE WHEN f3 < 1 THEN 'weight' END) AS factors
FROM integ WHERE f1 * f2 * f3 < 1 ORDER BY round(f1::DOUBLE * f2 * f3, 6), bout_id, fighter LIMIT 25""")
def bout_effects(spark, sf_dir):
    rows = library.bout_effects(reshape.long_factors(weights.integrity_appearances(Given(spark, sf_dir).bouts), LABELS, ["bout_id", "fighter"]).withColumn("multiplier", F.col("multiplier")))
    return rows.withColumn("total", r("total"))


# ---- periods, résumés, diagnostics


@query(""", p AS (SELECT fighter, event_date, event_seq, mu, avg(mu) OVER w AS roll, count(*) OVER w AS n FROM history
  WINDOW w AS (PARTITION BY fighter ORDER BY date_diff('day', DATE '1970-01-01', event_date) RANGE BETWEEN 364 PRECEDING AND CURRENT ROW)),
q AS (SELECT fighter, roll, event_date, row_number() OVER (PARTITION BY fighter ORDER BY roll DESC, event_date) AS k FROM p WHERE n >= 8)
SELECT fighter, round(roll, 6) AS peak_mean, CAST(event_date AS VARCHAR) AS peak_date FROM q WHERE k = 1""")
def rolling_mean_peak(spark, sf_dir):
    rows = periods.time_rolling_peak(Given(spark, sf_dir).history, 365, 8)
    return rows.select("fighter", r("peak_mean").alias("peak_mean"), F.col("peak_date").cast("string").alias("peak_date"))


def _rated_appearances(g: Given) -> DataFrame:
    """Appearances with their event's rating, as one stream."""
    rows = g.quality.join(g.history.select("fighter", "event_seq", "mu"), ["fighter", "event_seq"]).withColumn("stream", F.lit("surrogate"))
    return cut(rows, "appearances")


RATED_SQL = QUALITY_SQL + ", rated AS (SELECT v.*, h.mu FROM valued v JOIN history h ON h.fighter = v.fighter AND h.event_seq = v.event_seq)"

NORM_SQL = RATED_SQL + """, g AS (SELECT avg(mu) AS m, var_pop(mu) AS v, count(*) AS n FROM rated),
sp AS (SELECT fighter, CASE WHEN count(DISTINCT year(event_date)) > 1 THEN 1.0 ELSE 0 END AS spans FROM rated GROUP BY fighter),
yr AS (SELECT year(event_date) AS y, avg(r.mu) - any_value(g.m) AS shift, coalesce(var_samp(r.mu), any_value(g.v)) / count(*) AS se, avg(sp.spans) AS bridge FROM rated r JOIN sp USING (fighter), g GROUP BY 1),
ty AS (SELECT CASE WHEN count(*) >= 2 THEN greatest(0, var_pop(shift) - avg(se)) ELSE 0 END AS tau FROM yr),
flat AS (SELECT r.*, r.mu - yr.shift * CASE WHEN ty.tau > 0 THEN ty.tau / (ty.tau + yr.se) ELSE 0 END * yr.bridge AS flat FROM rated r JOIN yr ON yr.y = year(r.event_date), ty),
dv AS (SELECT division, avg(flat) AS dm, coalesce(var_samp(flat), any_value(g.v)) AS dvar, coalesce(var_samp(flat), any_value(g.v)) / count(*) AS se FROM flat, g GROUP BY division),
td AS (SELECT CASE WHEN count(*) >= 2 THEN greatest(0, var_pop(dm) - avg(se)) ELSE 0 END AS tau FROM dv),
norm AS (SELECT f.*, CASE WHEN g.n < 200 THEN f.mu ELSE 0.5 * f.mu + 0.5 * (g.m + sqrt(g.v) * (f.flat - (g.m + (dv.dm - g.m) * e.eb)) / greatest(sqrt(g.v) + (sqrt(dv.dvar) - sqrt(g.v)) * e.eb, 0.5 * sqrt(g.v))) END AS mu_norm
  FROM flat f JOIN dv USING (division) JOIN (SELECT division, CASE WHEN td.tau > 0 THEN td.tau / (td.tau + dv.se) ELSE 0 END AS eb FROM dv, td) e USING (division), g)"""


@query(NORM_SQL + " SELECT bout_id, fighter, round(mu, 4) AS mu, round(mu_norm, 4) AS mu_norm FROM norm")
def normalised_ratings(spark, sf_dir):
    return periods.normalised(_rated_appearances(Given(spark, sf_dir))).select("bout_id", "fighter", r("mu", 4).alias("mu"), r("mu_norm", 4).alias("mu_norm"))


PERIOD_SQL = NORM_SQL + """, num AS (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY event_date, event_name, bout_id) AS rn FROM norm),
win AS (SELECT e.fighter, e.rn AS end_rn, count(*) AS n, sum(w.t_bout) AS t, sum(w.t_win) AS tw, sum(w.t_defense) AS td, sum(w.period_weight) AS sw, sum(w.period_weight * (w.mu_norm + w.adjustment)) AS swx, sum(w.opp_weight) AS so,
    sum(w.period_weight * (w.mu_norm + w.adjustment) * (w.mu_norm + w.adjustment)) AS swxx, count(DISTINCT CASE WHEN w.is_title AND w.actual_score >= 1 THEN w.division END) AS divs
  FROM num e JOIN num w ON w.fighter = e.fighter AND w.rn <= e.rn AND date_diff('day', w.event_date, e.event_date) <= {days} GROUP BY 1, 2),
ok AS (SELECT *, n + 0.75 * t + tw + 0.75 * td AS eff, 2.0 * t + 3.0 * tw + 2.5 * td AS ladder FROM win WHERE n >= {least} OR (n >= {raw} AND n + 0.75 * t + tw + 0.75 * td >= {least})),
sc AS (SELECT *, swx / sw + least(50.0, greatest(0.0, 0.5 * greatest(0, n - {least}) + so)) + 30 * greatest(0, divs - 1) AS score, least(180.0, greatest(0.0, 2.0 * (so + ladder))) AS resume,
    greatest(0.0, swxx / sw - (swx / sw) * (swx / sw)) AS var FROM ok),
bt AS (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY score + resume DESC, end_rn) AS k FROM sc),
one AS (SELECT * FROM bt WHERE k = 1), pl AS (SELECT count(*) AS c, avg(score) AS m, var_pop(score) - avg(var / n) AS tau FROM one),
fin AS (SELECT fighter, n, CASE WHEN pl.c < 30 OR pl.tau <= 0 THEN score ELSE pl.m + (score - pl.m) * pl.tau / (pl.tau + var / n) END AS period_score, resume FROM one, pl)
SELECT fighter, n, round(period_score, 3) AS period_score, round(period_score + resume, 3) AS headline_score FROM fin"""


def _period(spark, sf_dir, spec):
    rows = periods.best_periods(periods.normalised(_rated_appearances(Given(spark, sf_dir))), *spec)
    return rows.select("fighter", "n", r("period_score", 3).alias("period_score"), r("headline_score", 3).alias("headline_score"))


@query(PERIOD_SQL.format(days=365, least=8, raw=6))
def best_period_one_year(spark, sf_dir):
    return _period(spark, sf_dir, (365, 8, 6))


@query(PERIOD_SQL.format(days=1825, least=8, raw=6))
def best_period_five_years(spark, sf_dir):
    return _period(spark, sf_dir, DEFAULT.five_year)


RESUME_SQL = RATED_SQL + """, rs AS (SELECT fighter, division, sum(period_weight * (mu + adjustment)) / sum(period_weight) AS base, count(*) AS division_fights, count(*) FILTER (actual_score >= 1) AS division_wins,
    count(*) FILTER (actual_score = 0) AS division_losses, count(*) FILTER (actual_score = 0.5) AS division_draws, sum(t_bout) AS tf, sum(t_win) AS tw, sum(t_defense) AS td, sum(opp_weight) AS so FROM rated GROUP BY 1, 2),
r2 AS (SELECT *, division_fights + 0.75 * tf + tw + 0.75 * td AS eff, base + least(180.0, greatest(0.0, 2.0 * (so + 2.0 * tf + 3.0 * tw + 2.5 * td))) AS raw FROM rs),
r3 AS (SELECT *, avg(raw) OVER (PARTITION BY division) + eff / (eff + 8) * (raw - avg(raw) OVER (PARTITION BY division)) AS division_score FROM r2)"""


@query(RESUME_SQL + " SELECT fighter, division, division_fights, division_wins, division_losses, division_draws, CAST(tf AS BIGINT) AS title_fights, round(eff, 6) AS effective_fights, round(raw, 4) AS score_raw, round(division_score, 4) AS division_score FROM r3")
def division_resumes(spark, sf_dir):
    rows = periods.resumes(_rated_appearances(Given(spark, sf_dir)))
    return rows.select("fighter", "division", "division_fights", "division_wins", "division_losses", "division_draws", "title_fights", r("effective_fights").alias("effective_fights"), r("score_raw", 4).alias("score_raw"), r("division_score", 4).alias("division_score"))


@query(RESUME_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY fighter ORDER BY eff DESC, tf DESC, division_score DESC) AS k, sum(eff) OVER (PARTITION BY fighter) AS total FROM r3)
SELECT fighter, division AS primary_division, round(eff / total, 6) AS primary_division_share FROM b WHERE k = 1""")
def primary_divisions(spark, sf_dir):
    return periods.primary_divisions(periods.resumes(_rated_appearances(Given(spark, sf_dir)))).withColumn("primary_division_share", r("primary_division_share"))


CALIBRATION_SQL = """, hb AS (SELECT fighter, event_seq, lag(mu) OVER w AS mu, row_number() OVER w - 1 AS prior FROM history WINDOW w AS (PARTITION BY fighter ORDER BY event_seq)),
cr AS (SELECT b.bout_id, b.division, b.fighter_a, b.fighter_b, 1 / (1 + exp(-(x.mu - y.mu) / 173.7178 / sqrt(1 + 3 * pow(100 / 173.7178, 2) / pow(pi(), 2)))) AS p, CASE WHEN b.winner = b.fighter_a THEN 1.0 ELSE 0 END AS s
  FROM bouts b JOIN seqs e USING (event_date, event_name) JOIN hb x ON x.event_seq = e.event_seq AND x.fighter = b.fighter_a JOIN hb y ON y.event_seq = e.event_seq AND y.fighter = b.fighter_b
  WHERE b.winner IS NOT NULL AND x.prior >= 3 AND y.prior >= 3),
sd AS (SELECT division, fighter_a AS fighter, p, s FROM cr UNION ALL SELECT division, fighter_b, 1 - p, 1 - s FROM cr),
sg AS (SELECT *, CASE WHEN CAST(substr(fighter, 2) AS INTEGER) % 2 = 0 THEN 'Orthodox' ELSE 'Unknown' END AS stance, CAST(greatest(ceil(p * 10) - 1, 0) AS INTEGER) AS prob_bin FROM sd),
cal AS (SELECT 'overall' AS segment_type, 'all' AS segment_value, prob_bin, avg(p) AS pm, avg(s) AS em, avg((p - s) * (p - s)) AS br, count(*) AS n FROM sg GROUP BY prob_bin
  UNION ALL SELECT 'division', division, prob_bin, avg(p), avg(s), avg((p - s) * (p - s)), count(*) FROM sg GROUP BY division, prob_bin
  UNION ALL SELECT 'stance', stance, prob_bin, avg(p), avg(s), avg((p - s) * (p - s)), count(*) FROM sg GROUP BY stance, prob_bin)"""


def _calibrated(g: Given) -> DataFrame:
    stances = g.apps.select("fighter").distinct().withColumn("stance", F.when(F.substring("fighter", 2, 9).cast("int") % 2 == 0, "Orthodox"))
    return diagnostics.calibration(snapshot.calibration_rows(g.bouts, g.history.withColumn("phi", F.lit(100.0)), stances=stances))


@query(CALIBRATION_SQL + " SELECT segment_type, segment_value, prob_bin, round(pm, 6) AS predicted_mean, round(em, 6) AS empirical_win_rate, round(br, 6) AS brier, n FROM cal")
def calibration(spark, sf_dir):
    return _calibrated(Given(spark, sf_dir)).select("segment_type", "segment_value", "prob_bin", *[r(c).alias(c) for c in ("predicted_mean", "empirical_win_rate", "brier")], "n")


@query(CALIBRATION_SQL + " SELECT segment_value, round(avg(abs(em - pm)), 6) AS mean_abs_residual, CAST(sum(n) AS BIGINT) AS n FROM cal WHERE segment_type = 'division' AND n >= 10 GROUP BY 1 ORDER BY avg(abs(em - pm)) DESC, 1 LIMIT 3")
def worst_segments(spark, sf_dir):
    return diagnostics.worst_segments(_calibrated(Given(spark, sf_dir)), least=10, top=3).select("segment_value", r("mean_abs_residual").alias("mean_abs_residual"), "n")


@query(""", j AS (SELECT year(a.event_date) AS year, a.division, a.fighter, arg_max(h.mu, (a.event_seq, a.bout_id)) AS mu FROM apps a JOIN history h USING (fighter, event_seq) GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY year, division ORDER BY mu DESC, fighter) AS k, count(*) OVER (PARTITION BY year, division) AS fighters FROM j),
e AS (SELECT *, exp((mu - max(mu) OVER w) / 100) AS x FROM k WHERE k <= 10 WINDOW w AS (PARTITION BY year, division)),
p AS (SELECT *, x / sum(x) OVER (PARTITION BY year, division) AS p FROM e)
SELECT CAST(year AS INTEGER) AS year, division, any_value(fighters) AS fighters_in_division, count(*) AS top_n, round(avg(mu), 6) AS top_mu_mean, round(stddev_pop(mu), 6) AS top_mu_std, max(mu) - min(mu) AS top_mu_range,
  round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy_normalized FROM p GROUP BY year, division""")
def division_entropy(spark, sf_dir):
    g = Given(spark, sf_dir)
    return diagnostics.entropy(g.apps, g.history).select("year", "division", "fighters_in_division", "top_n", r("top_mu_mean").alias("top_mu_mean"), r("top_mu_std").alias("top_mu_std"), "top_mu_range", r("entropy_normalized").alias("entropy_normalized"))


STRENGTH_SQL = """, eoy AS (SELECT fighter, year(event_date) AS year, arg_max(mu, event_seq) AS mu FROM history GROUP BY 1, 2),
pr AS (SELECT DISTINCT division, year(event_date) AS year, fighter FROM apps),
k AS (SELECT pr.*, eoy.mu, row_number() OVER (PARTITION BY division, pr.year ORDER BY mu DESC, pr.fighter) AS k FROM pr JOIN eoy ON eoy.fighter = pr.fighter AND eoy.year = pr.year),
st AS (SELECT division, year, avg(mu) AS strength, count(*) AS n FROM k WHERE k <= 15 GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query(STRENGTH_SQL + " SELECT division, CAST(year AS INTEGER) AS year, round(strength, 6) AS strength, n, round(100 * strength / max(strength) OVER (PARTITION BY year), 6) AS indexed FROM st")
def division_strength(spark, sf_dir):
    g = Given(spark, sf_dir)
    return diagnostics.strength(g.apps, g.history).select("division", "year", r("strength").alias("strength"), "n", r("indexed").alias("indexed"))


@query(STRENGTH_SQL + """, ix AS (SELECT division, year, 100 * strength / max(strength) OVER (PARTITION BY year) AS x FROM st)
SELECT division, round(any_value(x) FILTER (year = 1997), 4) AS y1997, round(any_value(x) FILTER (year = 1998), 4) AS y1998, round(any_value(x) FILTER (year = 1999), 4) AS y1999 FROM ix GROUP BY division""")
def era_matrix(spark, sf_dir):
    g = Given(spark, sf_dir)
    rows = library.era_matrix(diagnostics.strength(g.apps, g.history), [1997, 1998, 1999])
    return rows.select("division", *[r(F.col(f"`{y}`"), 4).alias(f"y{y}") for y in (1997, 1998, 1999)])


ATTRIBUTION_STREAMS = (("method", 1.0), ("method_integrity", 0.98), ("method_performance", 1.03), ("method_integrity_performance", 1.01))


def _streamed(g: Given) -> DataFrame:
    factor = F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.lit(f).alias("factor")) for s, f in ATTRIBUTION_STREAMS]))
    return g.history.select("*", factor.alias("_f")).select("fighter", "event_date", "event_name", "event_seq", F.col("_f.stream").alias("stream"), (1500 + (F.col("mu") - 1500) * F.col("_f.factor")).alias("mu"))


@query(""", d AS (SELECT fighter, event_seq, mu - coalesce(lag(mu) OVER (PARTITION BY fighter ORDER BY event_seq), 1500) AS d FROM history)
SELECT fighter, event_seq, round(d, 6) AS base_delta, round(-0.02 * d, 6) AS integrity_delta, round(0.03 * d, 6) AS performance_delta, round(0.0 * d, 6) + 0.0 AS interaction_delta, round(1.01 * d, 6) AS combined_delta FROM d""")
def rating_attribution(spark, sf_dir):
    rows = diagnostics.attribution(context.deltas(_streamed(Given(spark, sf_dir))))
    return rows.select("fighter", F.col("event_seq").cast("long").alias("event_seq"), *[(r(c) + 0.0).alias(c) for c in ("base_delta", "integrity_delta", "performance_delta", "interaction_delta", "combined_delta")])


@query(CURRENT_SQL + """, f AS (SELECT mu FROM current WHERE rating_periods >= 3)
SELECT fighter, round((SELECT count(*) FROM f WHERE f.mu < c.mu) / (SELECT count(*) FROM f), 6) AS percentile FROM current c""")
def caliber_percentiles(spark, sf_dir):
    return diagnostics.strictly_below(Given(spark, sf_dir).current, "mu", F.col("rating_periods") >= 3).select("fighter", r("percentile").alias("percentile"))


CROSSING_SQL = CURRENT_SQL + """, f AS (SELECT mu FROM current WHERE rating_periods >= 3),
cal AS (SELECT CASE WHEN CAST(substr(fighter, 2) AS INTEGER) % 3 = 0 THEN 'Unknown ' ELSE '' END || fighter AS fighter, (SELECT count(*) FROM f WHERE f.mu < c.mu) / (SELECT count(*) FROM f) AS pct FROM current c),
sx AS (SELECT bout_id, fighter, opponent FROM apps), inf AS (SELECT s.fighter, median(o.pct) AS pct FROM sx s LEFT JOIN cal m ON m.fighter = s.fighter LEFT JOIN cal o ON o.fighter = s.opponent WHERE m.pct IS NULL GROUP BY 1)"""


@query(CROSSING_SQL + """ SELECT s.bout_id, round(least(1.0, greatest(0.5, avg(coalesce(c.pct, i.pct, 0.3)))), 6) AS fight_weight FROM sx s LEFT JOIN cal c ON c.fighter = s.fighter LEFT JOIN inf i ON i.fighter = s.fighter GROUP BY 1""")
def crossing_weights(spark, sf_dir):
    g = Given(spark, sf_dir)
    caliber = diagnostics.strictly_below(g.current, "mu", F.col("rating_periods") >= 3)
    # every third one goes by a name that no bout has
    caliber = caliber.withColumn("fighter", F.concat(F.when(F.substring("fighter", 2, 9).cast("int") % 3 == 0, "Unknown ").otherwise(""), "fighter"))
    return diagnostics.crossing_weights(g.bouts, caliber).withColumn("fight_weight", r("fight_weight"))


@query(CURRENT_SQL + """, f AS (SELECT fighter, mu FROM current WHERE rating_periods >= 3),
pp AS (SELECT DISTINCT b.division AS org, u.fighter FROM bouts b, LATERAL (SELECT unnest([b.fighter_a, b.fighter_b]) AS fighter) u),
md AS (SELECT org, median(f.mu) AS mu FROM pp LEFT JOIN f USING (fighter) GROUP BY org)
SELECT org, round(CASE WHEN mu IS NULL THEN 0.5 ELSE least(0.95, greatest(0.5, (SELECT count(*) FROM f WHERE f.mu < md.mu) / (SELECT count(*) FROM f))) END, 6) AS org_weight FROM md""")
def organisation_weights(spark, sf_dir):
    g = Given(spark, sf_dir)
    return diagnostics.organisation_weights(g.bouts.withColumn("org", F.col("division")), g.current).withColumn("org_weight", r("org_weight"))


# ---- rating formulas


@query(""" SELECT bout_id, round(1 / (1 + exp(-(x.mu - y.mu) / 173.7178 / sqrt(1 + 3 * pow(80 / 173.7178, 2) / pow(pi(), 2)))), 6) AS p_a,
  round(2 * (0.5 - abs(0.5 - (1 / (1 + exp(-(x.mu - y.mu) / sqrt(1 + 3 * 60 * 60 / pow(pi(), 2)))) + 1 / (1 + exp(-(y.mu - x.mu) / sqrt(1 + 3 * 80 * 80 / pow(pi(), 2))))) / 2)), 6) AS quality
FROM bouts b JOIN seqs e USING (event_date, event_name) JOIN history x ON x.event_seq = e.event_seq AND x.fighter = b.fighter_a JOIN history y ON y.event_seq = e.event_seq AND y.fighter = b.fighter_b""")
def win_probabilities(spark, sf_dir):
    g = Given(spark, sf_dir)
    rows = g.bouts
    for s in "ab":
        rows = rows.join(g.history.select("event_seq", F.col("fighter").alias(f"fighter_{s}"), F.col("mu").alias(f"mu_{s}")), ["event_seq", f"fighter_{s}"])
    p = ratings.win_probability(F.col("mu_a"), F.col("mu_b"), F.lit(80.0))
    return rows.select("bout_id", r(p).alias("p_a"), r(ratings.match_quality(F.col("mu_a"), F.lit(60.0), F.col("mu_b"), F.lit(80.0))).alias("quality"))


PERIOD_SUMS_SQL = """, pf AS (SELECT *, coalesce(lag(mu) OVER (PARTITION BY fighter ORDER BY event_seq), 1500) AS m FROM history),
t AS (SELECT a.fighter, a.event_seq, 1 / sqrt(1 + 3 * pow(120 / 173.7178, 2) / pow(pi(), 2)) AS g, 1 / (1 + exp(-(x.m - y.m) / 173.7178 / sqrt(1 + 3 * pow(120 / 173.7178, 2) / pow(pi(), 2)))) AS e,
    CASE WHEN a.is_draw THEN 0.5 WHEN a.is_winner THEN 1.0 ELSE 0 END AS s FROM apps a JOIN pf x ON x.fighter = a.fighter AND x.event_seq = a.event_seq JOIN pf y ON y.fighter = a.opponent AND y.event_seq = a.event_seq)
SELECT fighter, event_seq, round(sum(g * g * e * (1 - e)), 6) AS v_inv, round(sum(g * (s - e)), 6) AS total FROM t GROUP BY 1, 2"""


@query(PERIOD_SUMS_SQL)
def period_information(spark, sf_dir):
    g = Given(spark, sf_dir)
    before = context.prefight(g.history).select("event_seq", "fighter", ratings.scaled(F.col("prefight_mu")).alias("m"))
    rows = g.apps.join(before, ["event_seq", "fighter"]).join(before.select("event_seq", F.col("fighter").alias("opponent"), F.col("m").alias("o")), ["event_seq", "opponent"])
    phi = F.lit(120.0 / DEFAULT.ratio)
    gg, e = ratings.impact(phi), ratings.expected(F.col("m"), F.col("o"), phi)
    return rows.groupBy("fighter", F.col("event_seq").cast("long").alias("event_seq")).agg(r(F.sum(gg * gg * e * (1 - e))).alias("v_inv"), r(F.sum(gg * (F.col("actual_score") - e))).alias("total"))


@query(CURRENT_SQL + """, z AS (SELECT *, greatest(0.0, date_diff('day', last_event_date, (SELECT max(last_event_date) FROM current)) / 30.4375) AS months FROM current)
SELECT fighter, round(months, 2) AS months_inactive, round(75 * pow(least(1.0, greatest(0.0, (months - 15) / 15)), 2) * (1 - phi / 350.0), 5) AS penalty,
  round(173.7178 * sqrt(pow(phi / 173.7178, 2) + CAST(floor(months) AS INTEGER) * 0.0036), 5) AS phi_inflated FROM z""")
def inactivity(spark, sf_dir):
    rows = snapshot.with_idle_penalty(Given(spark, sf_dir).current)
    end = rows.agg(F.max("last_event_date").alias("_end"))
    idle = F.floor(F.datediff("_end", "last_event_date") / DEFAULT.days_per_month)
    rows = rows.crossJoin(F.broadcast(end))
    return rows.select("fighter", "months_inactive", r("activity_mu_penalty", 5).alias("penalty"), r(ratings.inflated(F.col("phi"), F.lit(0.06), idle), 5).alias("phi_inflated"))


# ---- query library


@query(CURRENT_SQL + " SELECT fighter, mu, rating_periods, recent_division, row_number() OVER (ORDER BY mu DESC, fighter) AS rank FROM current WHERE rating_periods >= 3 AND recent_division = 'Lightweight' ORDER BY mu DESC, fighter LIMIT 10")
def leaderboard_division(spark, sf_dir):
    return library.leaderboard(Given(spark, sf_dir).current, n=10, division="Lightweight").select("fighter", "mu", "rating_periods", "recent_division", F.col("rank").cast("long").alias("rank"))


@query(CURRENT_SQL + " SELECT fighter, mu, rank() OVER (ORDER BY mu DESC) AS rank FROM current WHERE rating_periods >= 3")
def competition_ranks(spark, sf_dir):
    return library.ranked(Given(spark, sf_dir).current).select("fighter", "mu", F.col("rank").cast("long").alias("rank"))


@query(CURRENT_SQL + ", k AS (SELECT fighter, recent_division, mu, row_number() OVER (PARTITION BY recent_division ORDER BY mu DESC, fighter) AS position FROM current) SELECT * FROM k WHERE position <= 8")
def top_by_division(spark, sf_dir):
    return library.top_by_group(Given(spark, sf_dir).current, "recent_division", "mu").select("fighter", "recent_division", "mu", F.col("position").cast("long").alias("position"))


@query(CURRENT_SQL + ", lo AS (SELECT fighter, mu FROM current ORDER BY mu, fighter LIMIT 15), hi AS (SELECT fighter, mu FROM current ORDER BY mu DESC, fighter LIMIT 15) SELECT * FROM lo UNION SELECT * FROM hi")
def rating_extremes(spark, sf_dir):
    return library.extremes(Given(spark, sf_dir).current.select("fighter", "mu"), "mu")


def _snapshot_before(g: Given) -> DataFrame:
    rows = g.history.where(F.col("event_date") < F.lit("1998-01-01").cast("date"))
    return rows.groupBy("fighter").agg(F.max_by("mu", "event_seq").alias("mu"), F.count(F.lit(1)).alias("rating_periods"))


OLD_SQL = CURRENT_SQL + ", old AS (SELECT fighter, arg_max(mu, event_seq) AS mu, count(*) AS rating_periods FROM history WHERE event_date < DATE '1998-01-01' GROUP BY fighter)"


@query(OLD_SQL + """, o AS (SELECT fighter, row_number() OVER (ORDER BY mu DESC, fighter) AS k FROM old WHERE rating_periods >= 3), n AS (SELECT fighter, row_number() OVER (ORDER BY mu DESC, fighter) AS k FROM current WHERE rating_periods >= 3),
m AS (SELECT fighter, o.k AS rank_old, n.k AS rank_new FROM (SELECT * FROM o WHERE k <= 20) o FULL JOIN (SELECT * FROM n WHERE k <= 20) n USING (fighter))
SELECT fighter, rank_old, rank_new, coalesce(rank_old, 21) - coalesce(rank_new, 21) AS move, CASE WHEN rank_old IS NULL THEN 'Entered' WHEN rank_new IS NULL THEN 'Left' WHEN coalesce(rank_old, 21) > coalesce(rank_new, 21) THEN 'Up' ELSE 'Down' END AS status
FROM m WHERE coalesce(rank_old, 21) <> coalesce(rank_new, 21) ORDER BY abs(coalesce(rank_old, 21) - coalesce(rank_new, 21)) DESC, coalesce(rank_new, 21), fighter LIMIT 20""")
def rank_movers(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.movers(_snapshot_before(g), g.current, top=20, n=20).select("fighter", *[F.col(c).cast("long").alias(c) for c in ("rank_old", "rank_new", "move")], "status")


@query(OLD_SQL + """, d AS (SELECT c.fighter, c.mu AS new, o.mu AS old, c.mu - o.mu AS delta FROM current c JOIN old o USING (fighter)),
lo AS (SELECT * FROM d ORDER BY delta, fighter LIMIT 10), hi AS (SELECT * FROM d ORDER BY delta DESC, fighter LIMIT 10) SELECT * FROM lo UNION SELECT * FROM hi""")
def snapshot_deltas(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.snapshot_deltas(_snapshot_before(g), g.current)


@query(CURRENT_SQL + """ SELECT a.fighter AS fighter_a, b.fighter AS fighter_b, round(1 / (1 + exp(-(a.mu - b.mu) / 173.7178 / sqrt(1 + 3 * pow(b.phi / 173.7178, 2) / pow(pi(), 2)))), 4) AS win_a FROM current a, current b WHERE a.fighter = 'S1' AND b.fighter = 'S2'""")
def head_to_head(spark, sf_dir):
    return library.head_to_head(Given(spark, sf_dir).current, "S1", "S2").select("fighter_a", "fighter_b", "win_a")


@query(f", rec AS ({RECORDS_SQL})" + CURRENT_SQL + " SELECT c.fighter, mu, round(mu - 1.96 * phi, 4) AS mu_low, round(mu + 1.96 * phi, 4) AS mu_high, wins, losses, draws FROM current c JOIN rec USING (fighter) WHERE c.fighter = 'S3'")
def fighter_card(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.card(g.current, g.apps, "S3").select("fighter", "mu", r("mu_low", 4).alias("mu_low"), r("mu_high", 4).alias("mu_high"), "wins", "losses", "draws")


@query(""", w AS (SELECT fighter, event_seq, string_agg(DISTINCT method_class, ', ' ORDER BY method_class) AS markers FROM apps WHERE is_winner AND fighter IN ('S1', 'S2') GROUP BY 1, 2)
SELECT h.fighter, CAST(h.event_date AS VARCHAR) AS event_date, h.mu, w.markers FROM history h LEFT JOIN w USING (fighter, event_seq) WHERE h.fighter IN ('S1', 'S2')""")
def trajectories(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.trajectory(g.history.withColumn("phi", F.lit(80.0)), g.apps, ["S1", "S2"]).select("fighter", F.col("event_date").cast("string").alias("event_date"), "mu", "markers")


@query(CURRENT_SQL + " SELECT fighter, mu FROM current WHERE contains(lower(fighter), 's1') ORDER BY mu DESC, fighter LIMIT 20")
def competitor_search(spark, sf_dir):
    return library.search(Given(spark, sf_dir).current, "S1").select("fighter", "mu")


@query(CURRENT_SQL + ", t AS (SELECT * FROM current ORDER BY mu DESC, fighter LIMIT 50) SELECT recent_division, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY recent_division")
def density_share(spark, sf_dir):
    return library.density_share(Given(spark, sf_dir).current, "mu", 50).withColumn("share", r("share"))


@query(""", c AS (SELECT bout_id, CAST(substr(fighter_a, 2) AS INTEGER) AS s FROM bouts)
SELECT bout_id, CASE s % 4 WHEN 2 THEN 'split' WHEN 1 THEN 'majority' ELSE 'unanimous' END AS decision FROM c""")
def scorecard_decisions(spark, sf_dir):
    return library.scorecards(Given(spark, sf_dir).bouts)


@query(CURRENT_SQL + ", l AS (SELECT regr_slope(mu, rating_periods) AS k, regr_intercept(mu, rating_periods) AS c FROM current) SELECT fighter, round(mu - k * rating_periods - c, 4) AS residual FROM current, l")
def residual_fit(spark, sf_dir):
    return library.residual_fit(Given(spark, sf_dir).current, "rating_periods", "mu").select("fighter", r("residual", 4).alias("residual"))


@query(""", s AS (SELECT l_orderkey AS bout_id, 'S' || l_suppkey AS fighter, sum(l_quantity) AS q, sum(round(l_discount * 100, 0)) AS d, count(*) AS n FROM lineitem GROUP BY 1, 2),
j AS (SELECT s.*, CASE WHEN (greatest(end_round, 1) - 1) * 300 + end_time_seconds > 0 THEN (greatest(end_round, 1) - 1) * 300 + end_time_seconds ELSE n * 300 END AS sec FROM s JOIN bouts USING (bout_id))
SELECT fighter, count(*) AS bouts, round(sum(q) * 60 / sum(sec), 6) AS strikes_per_minute, round(sum(d) * 900 / sum(sec), 6) AS attempts_per_15 FROM j GROUP BY fighter HAVING count(*) >= 5""")
def pace_statistics(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.pace(g.rounds, g.bouts).select("fighter", "bouts", r("strikes_per_minute").alias("strikes_per_minute"), r("attempts_per_15").alias("attempts_per_15"))


@query(CURRENT_SQL + """, z AS (SELECT fighter, (mu - avg(mu) OVER ()) / stddev_samp(mu) OVER () AS z1, (rating_periods - avg(rating_periods) OVER ()) / stddev_samp(rating_periods) OVER () AS z2, rank() OVER (ORDER BY mu DESC) AS r1, rank() OVER (ORDER BY rating_periods DESC) AS r2 FROM current)
SELECT fighter, round(z1, 6) AS z_mu, CAST(r1 AS INTEGER) AS rank_mu, (r1 + r2) / 2 AS mean_rank, CAST(abs(r1 - r2) AS INTEGER) AS rank_spread, round(abs(z1 - z2), 6) AS z_spread FROM z""")
def metric_ranks(spark, sf_dir):
    rows = library.metric_ranks(Given(spark, sf_dir).current, ["mu", "rating_periods"])
    return rows.select("fighter", r("z_mu").alias("z_mu"), "rank_mu", "mean_rank", "rank_spread", r("z_spread").alias("z_spread"))


# ---- sources: catalog, odds, sets


@query(""" SELECT 'bouts' AS table_name, count(*) AS n_rows, CAST(min(event_date) AS VARCHAR) AS min_date, CAST(max(event_date) AS VARCHAR) AS max_date, NULL::BIGINT AS n_fighters FROM bouts
UNION ALL SELECT 'history', count(*), CAST(min(event_date) AS VARCHAR), CAST(max(event_date) AS VARCHAR), count(DISTINCT fighter) FROM history""")
def source_coverage(spark, sf_dir):
    g = Given(spark, sf_dir)
    rows = catalog.coverage({"bouts": g.bouts, "history": g.history})
    return rows.select("table_name", "n_rows", F.col("min_date").cast("string").alias("min_date"), F.col("max_date").cast("string").alias("max_date"), "n_fighters")


def _vendor(g: Given) -> DataFrame:
    """Vendor odds for all bouts, some days off, every third one far off; sides turned for odd ones."""
    odd = F.col("bout_id") % 2 == 1
    a, b = F.when(odd, F.col("fighter_b")).otherwise(F.col("fighter_a")), F.when(odd, F.col("fighter_a")).otherwise(F.col("fighter_b"))
    rows = g.bouts.select(a.alias("R_fighter"), b.alias("B_fighter"), (100 + F.col("qty_a")).alias("R_odds"), (-110 - F.col("qty_b")).alias("B_odds"), F.date_add("event_date", (F.col("bout_id") % 4 + F.when(F.col("bout_id") % 3 == 0, 30).otherwise(0)).cast("int")).alias("odds_date"))
    return rows.withColumn("pair_key", clean.pair_key(F.lower("R_fighter"), F.lower("B_fighter")))


VENDOR_SQL = """, vendor AS (SELECT CASE WHEN bout_id % 2 = 1 THEN fighter_b ELSE fighter_a END AS rf, CASE WHEN bout_id % 2 = 1 THEN fighter_a ELSE fighter_b END AS bf, 100 + qty_a AS ro, -110 - qty_b AS bo, event_date + CAST(bout_id % 4 + CASE WHEN bout_id % 3 = 0 THEN 30 ELSE 0 END AS INTEGER) AS od FROM bouts),
near AS (SELECT b.bout_id, b.fighter_a, v.*, abs(date_diff('day', v.od, b.event_date)) AS dd FROM bouts b JOIN vendor v ON least(v.rf, v.bf) = least(b.fighter_a, b.fighter_b) AND greatest(v.rf, v.bf) = greatest(b.fighter_a, b.fighter_b) WHERE abs(date_diff('day', v.od, b.event_date)) <= 2),
best AS (SELECT *, row_number() OVER (PARTITION BY bout_id ORDER BY dd, od, ro) AS k FROM near),
matched AS (SELECT bout_id, dd AS date_diff, CASE WHEN rf = fighter_a THEN ro ELSE bo END AS american_odds_a, CASE WHEN rf = fighter_a THEN bo ELSE ro END AS american_odds_b FROM best WHERE k = 1)"""


@query(VENDOR_SQL + " SELECT * FROM matched")
def matched_odds(spark, sf_dir):
    g = Given(spark, sf_dir)
    return raw.matched_odds(g.bouts, _vendor(g)).select("bout_id", F.col("date_diff").cast("long").alias("date_diff"), "american_odds_a", "american_odds_b")


@query(VENDOR_SQL + ODDS_SQL + " SELECT bout_id, american_odds_a FROM matched UNION ALL SELECT bout_id, american_odds_a FROM odds WHERE bout_id NOT IN (SELECT bout_id FROM matched)")
def upserted_odds(spark, sf_dir):
    g = Given(spark, sf_dir)
    new = raw.matched_odds(g.bouts, _vendor(g)).select("bout_id", "american_odds_a")
    return raw.upserted(new, adapters.odds(spark, sf_dir, g.bouts).select("bout_id", "american_odds_a"), "bout_id")


@query(""", a AS (SELECT DISTINCT fighter_a AS f FROM bouts WHERE is_title), b AS (SELECT DISTINCT fighter_b AS f FROM bouts WHERE is_draw)
SELECT 'both' AS kind, f AS fighter FROM (SELECT f FROM a INTERSECT SELECT f FROM b) UNION ALL SELECT 'only_title', f FROM (SELECT f FROM a EXCEPT SELECT f FROM b) UNION ALL SELECT 'any', f FROM (SELECT f FROM a UNION SELECT f FROM b)""")
def competitor_sets(spark, sf_dir):
    g = Given(spark, sf_dir)
    a, b = g.bouts.where("is_title").select(F.col("fighter_a").alias("fighter")).distinct(), g.bouts.where("is_draw").select(F.col("fighter_b").alias("fighter")).distinct()
    kinds = {"both": a.intersect(b), "only_title": a.exceptAll(b), "any": a.union(b).distinct()}
    parts = [df.select(F.lit(k).alias("kind"), "fighter") for k, df in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


# ---- text and second adapter


@query(""" SELECT p_partkey, p_size // 12 * 12 + p_size % 12 AS height_inches, p_size * 60 + 30 AS seconds, p_size AS landed, p_size + 3 AS attempted, p_size / 100.0 AS pct, 100 + p_size AS weight_lb, 60.5 AS reach FROM part""", bouts=False)
def parsed_fields(spark, sf_dir):
    n = F.col("p_size")
    rows = adapters.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.floor(n / 12), F.lit("' "), n % 12, F.lit('"')).alias("h"), F.concat(n, F.lit(":30")).alias("c"), F.concat(n, F.lit(" of "), n + 3).alias("o"), F.concat(n, F.lit("%")).alias("p"), F.concat(n + 100, F.lit(" lbs.")).alias("w"), F.lit('60.5"').alias("rc"))
    landed, attempted = clean.of_pair(F.col("o"))
    return rows.select("p_partkey", clean.height_inches(F.col("h")).alias("height_inches"), clean.clock_seconds(F.col("c")).alias("seconds"), landed.alias("landed"), attempted.alias("attempted"), clean.percent(F.col("p")).alias("pct"), clean.pounds(F.col("w")).alias("weight_lb"), clean.reach_inches(F.col("rc")).alias("reach"))


@query(" SELECT bout_id, division, is_title AND division <> 'Catch Weight' AS title, is_interim AS interim FROM bouts")
def weight_class_labels(spark, sf_dir):
    return Given(spark, sf_dir).bouts.select("bout_id", clean.division(F.col("weight_class")).alias("division"), clean.title_bout(F.col("weight_class")).alias("title"), clean.interim_bout(F.col("weight_class")).alias("interim"))


@query(" SELECT bout_id, method_class, CASE method_class WHEN 'KO/TKO' THEN 1.0::DOUBLE WHEN 'Submission' THEN 1.0 WHEN 'Decision - Unanimous' THEN 0.95 WHEN 'DQ' THEN 0.85 ELSE 0.90 END AS score FROM bouts")
def method_classes(spark, sf_dir):
    rows = Given(spark, sf_dir).bouts.select("bout_id", F.when(F.col("method_class") == "KO/TKO", "TKO - Doctor's Stoppage").when(F.col("method_class") == "Submission", " SUB ").otherwise(F.col("method_class")).alias("m"))
    return rows.select("bout_id", clean.method_class(F.col("m")).alias("method_class")).withColumn("score", clean.method_score(F.col("method_class")))


@query(" SELECT c_custkey, lower(trim(c_name)) AS name_key, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS compact_key, regexp_replace(lower(c_name), '[^a-z0-9]+', '+', 'g') AS slug FROM customer", bouts=False)
def name_keys(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", names.folded(F.col("c_name")).alias("name_key"), names.compact(names.folded(F.col("c_name"))).alias("compact_key"), clean.slug(F.col("c_name")).alias("slug"))


@query(" SELECT bout_id, CASE WHEN bout_id % 2 = 0 THEN fighter_a ELSE fighter_b END AS flagged FROM bouts")
def flagged_competitors(spark, sf_dir):
    word = F.translate(F.col("fighter"), "S0123456789", "sabcdefghij")
    g = Given(spark, sf_dir)
    rows = g.bouts.select("bout_id", "fighter_a", "fighter_b", *[F.concat(F.lit("Kid "), F.translate(f"fighter_{s}", "S0123456789", "zabcdefghij"), F.lit("quux")).alias(f"n_{s}") for s in "ab"])
    details = F.concat(F.lit("Overturned; failed drug test by "), F.when(F.col("bout_id") % 2 == 0, F.element_at(F.split("n_a", " "), -1)).otherwise(F.element_at(F.split("n_b", " "), -1)))
    who = clean.flagged_side(details, F.col("n_a"), F.col("n_b"))
    return rows.select("bout_id", F.when(who == F.col("n_a"), F.col("fighter_a")).when(who == F.col("n_b"), F.col("fighter_b")).alias("flagged"))


EVENT_APPS_SQL = """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, CASE event_type WHEN 'purchase' THEN 'win' WHEN 'error' THEN 'loss' WHEN 'view' THEN 'nc' ELSE 'draw' END AS outcome FROM events),
i AS (SELECT *, sum(CASE WHEN outcome = 'win' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY d, event_id) AS isl FROM e WHERE outcome <> 'nc')
SELECT CAST(user_id AS VARCHAR) AS fighter, count(*) AS length, CAST(min(d) AS VARCHAR) AS start_date, CAST(max(d) AS VARCHAR) AS end_date FROM i WHERE outcome = 'win' GROUP BY user_id, isl HAVING count(*) >= 2"""


@query(EVENT_APPS_SQL, bouts=False)
def event_streaks(spark, sf_dir):
    kind = F.col("event_type")
    rows = adapters.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("bout_id"), F.to_date("ts").alias("event_date"), F.lit("").alias("event_name"), F.col("user_id").cast("string").alias("fighter"), F.lit("x").alias("opponent"), (kind == "purchase").alias("is_winner"),
        kind.isin("click", "signup").alias("is_draw"), (kind == "view").alias("is_nc"), F.lit("d").alias("division"), F.lit(False).alias("is_title"), F.lit("").alias("method_class"),
    )
    return context.all_streaks(rows).select("fighter", "length", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


# ---- kernels and whole runs: no SQL; tested against brute force


def _kernel_bouts(spark, sf_dir) -> DataFrame:
    """The columns that the kernels take, stored before events are numbered: the wide bouts are made once and not kept."""
    kept = weights.scored(adapters.bouts(spark, sf_dir)).select("bout_id", "event_date", "event_name", "fighter_a", "fighter_b", "winner", "is_draw", "quality_score")
    return adapters.sequenced(cut(kept, "bouts"))


@query()
def glicko_streams(spark, sf_dir):
    # pools pass tasks of their own, so none sorts and holds a whole stream; the rows keep the one name
    return snapshot.base_history(snapshot.pooled(_kernel_bouts(spark, sf_dir))).withColumn("pool", F.lit("all"))


@query()
def whole_history_ratings(spark, sf_dir):
    bouts = snapshot.pooled(_kernel_bouts(spark, sf_dir))
    return kernels.smooth_streams(kernels.for_streams(bouts, {"whr": {"score": "quality_score"}}))


@query()
def rating_run(spark, sf_dir):
    g = Given(spark, sf_dir, stored=True)
    return snapshot.run(g.bouts.drop("event_seq"), g.rounds, g.odds, lean=True)["current"]


@query()
def tuned_ratings(spark, sf_dir):
    return snapshot.tuned(_kernel_bouts(spark, sf_dir), {"base": DEFAULT, "calm": DEFAULT.with_(tau=0.3)})


@query(""" SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'Lightweight' ELSE 'Flyweight' END AS division, CAST(s_suppkey % 20 + 1 AS INTEGER) AS rank, 'S' || s_suppkey AS fighter,
  CASE WHEN s_suppkey % 3 <> 0 THEN CAST(20 + s_suppkey % 15 AS INTEGER) END AS age, '3-1-0' AS record, CAST(s_suppkey * 2 AS DOUBLE) AS points, '/fighter-profile/' || s_suppkey || '/' AS profile_url FROM supplier""", bouts=False)
def ranking_pages(spark, sf_dir):
    return raw.rankings(adapters.ranking_pages(spark, sf_dir)).select("division", "rank", "fighter", "age", "record", "points", "profile_url")


# ---- outside rankings, audits, cards


def _outside(g: Given) -> DataFrame:
    """An outside ranking made of the suppliers: points by balance, rank by key, two rows for some names."""
    rows = adapters.table(g.spark, g.dir, "supplier")
    once = rows.select(F.concat(F.when(F.col("s_suppkey") % 4 == 0, " unknown").otherwise(" s"), F.col("s_suppkey"), F.lit(" ")).alias("fighter"), (F.col("s_suppkey") % 20 + 1).cast("int").alias("rank"), F.when(F.col("s_nationkey") % 2 == 0, "Lightweight").otherwise("Flyweight").alias("division"), F.col("s_acctbal").alias("points"))
    twice = once.where("rank % 3 = 0").withColumns({"division": F.lit("Open"), "points": F.col("points") + 10})
    return names.with_name_key(once.unionByName(twice), "fighter")


OUTSIDE_SQL = """, o1 AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE 's' END || s_suppkey AS name_key, CAST(s_suppkey % 20 + 1 AS INTEGER) AS rank, CASE WHEN s_nationkey % 2 = 0 THEN 'Lightweight' ELSE 'Flyweight' END AS division, s_acctbal AS points FROM supplier),
outside AS (SELECT * FROM o1 UNION ALL SELECT name_key, rank, 'Open', points + 10 FROM o1 WHERE rank % 3 = 0)"""


@query(CURRENT_SQL + OUTSIDE_SQL + """, b AS (SELECT *, row_number() OVER (PARTITION BY name_key ORDER BY points DESC, rank, division) AS k FROM outside),
m AS (SELECT fighter, rank() OVER (ORDER BY mu DESC) AS rank FROM current WHERE rating_periods >= 3)
SELECT m.fighter, m.rank, b.rank AS outside_rank, round(b.points, 2) AS points, b.rank - m.rank AS gap FROM m LEFT JOIN b ON b.name_key = lower(m.fighter) AND b.k = 1""")
def outside_rank_gap(spark, sf_dir):
    g = Given(spark, sf_dir)
    rows = library.rank_gap(names.with_name_key(g.current, "fighter"), _outside(g))
    return rows.select("fighter", F.col("rank").cast("long").alias("rank"), "outside_rank", r("points", 2).alias("points"), F.col("gap").cast("long").alias("gap"))


@query(CURRENT_SQL + OUTSIDE_SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY recent_division ORDER BY mu DESC, fighter) AS k FROM current),
a AS (SELECT recent_division AS division, avg(mu) AS mean_rating, count(*) AS n_rated FROM t WHERE k <= 15 GROUP BY 1), b AS (SELECT division, avg(points) AS mean_points, count(*) AS n_ranked FROM outside WHERE rank <= 15 GROUP BY 1)
SELECT division, round(mean_rating, 4) AS mean_rating, n_rated, round(mean_points, 4) AS mean_points, n_ranked FROM a FULL JOIN b USING (division)""")
def division_comparison(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.division_comparison(g.current, _outside(g)).select("division", r("mean_rating", 4).alias("mean_rating"), "n_rated", r("mean_points", 4).alias("mean_points"), "n_ranked")


@query(PERFORMANCE_SQL + " SELECT bout_id, fighter, round(f_rank * f_title * f_p4p, 6) AS impact FROM perf WHERE f_rank * f_title * f_p4p > 1.0001 ORDER BY f_rank * f_title * f_p4p DESC, bout_id, fighter LIMIT 25")
def context_impact(spark, sf_dir):
    return library.context_impact(_performance(Given(spark, sf_dir)), ["f_rank", "f_title", "f_p4p"]).select("bout_id", "fighter", r("impact").alias("impact"))


@query(PERFORMANCE_SQL + " SELECT bout_id, fighter, f_class::DOUBLE AS impact FROM perf WHERE f_class > 1.0001 ORDER BY f_class DESC, bout_id, fighter LIMIT 25")
def class_move_impact(spark, sf_dir):
    return library.context_impact(_performance(Given(spark, sf_dir)), ["f_class"]).select("bout_id", "fighter", "impact")


@query(" SELECT fighter, event_seq, mu FROM history WHERE fighter = 'S4' ORDER BY event_seq DESC LIMIT 25")
def recent_events(spark, sf_dir):
    return library.recent_rows(Given(spark, sf_dir).history, "S4").select("fighter", F.col("event_seq").cast("long").alias("event_seq"), "mu")


@query(""", d AS (SELECT mu - coalesce(lag(mu) OVER (ORDER BY event_seq), 1500) AS d FROM history WHERE fighter = 'S4'), s AS (SELECT sum(d) AS t FROM d)
SELECT 'S4' AS fighter, c AS component, round(f * t, 4) + 0.0 AS total FROM s, (VALUES ('base_delta', 1.0), ('integrity_delta', -0.02), ('performance_delta', 0.03), ('interaction_delta', 0.0)) v(c, f)""")
def attribution_totals(spark, sf_dir):
    rows = library.attribution_totals(diagnostics.attribution(context.deltas(_streamed(Given(spark, sf_dir)))), "S4")
    return rows.select("fighter", "component", (r("total", 4) + 0.0).alias("total"))


@query(ODDS_SQL + """ SELECT bout_id, CAST(event_date AS VARCHAR) AS event_date, 'S4' AS fighter, round(CASE WHEN fighter_a = 'S4' THEN prob_a ELSE prob_b END, 6) AS market_prob,
  CASE WHEN is_draw THEN 'draw' WHEN winner = 'S4' THEN 'win' ELSE 'loss' END AS result FROM lines_ok WHERE odds_data_quality = 'ok' AND 'S4' IN (fighter_a, fighter_b)""")
def odds_history(spark, sf_dir):
    rows = library.odds_history(Given(spark, sf_dir).odds, "S4")
    return rows.select("bout_id", F.col("event_date").cast("string").alias("event_date"), "fighter", r("market_prob").alias("market_prob"), "result")


@query(""", d AS (SELECT event_seq, string_agg(CASE WHEN is_draw THEN 'draw' WHEN is_winner THEN 'win' ELSE 'loss' END, ', ' ORDER BY CASE WHEN is_draw THEN 'draw' WHEN is_winner THEN 'win' ELSE 'loss' END) AS results FROM apps WHERE fighter = 'S4' GROUP BY 1)
SELECT h.event_seq, h.mu, d.results FROM history h LEFT JOIN d USING (event_seq) WHERE h.fighter = 'S4'""")
def streak_timeline(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.streak_timeline(g.history, g.apps, "S4").select(F.col("event_seq").cast("long").alias("event_seq"), "mu", "results")


@query(CURRENT_SQL + " SELECT recent_division, round(avg(mu), 4) AS mean, max(mu) AS best, count(*) AS n FROM current GROUP BY 1")
def division_summary(spark, sf_dir):
    return library.division_summary(Given(spark, sf_dir).current).withColumn("mean", r("mean", 4))


@query(CURRENT_SQL + """, l AS (SELECT regr_slope(mu, rating_periods) AS k, regr_intercept(mu, rating_periods) AS c FROM current), e AS (SELECT mu - k * rating_periods - c AS residual FROM current, l)
SELECT CASE WHEN residual > 0 THEN 'positive' WHEN residual < 0 THEN 'negative' ELSE 'none' END AS cohort, count(*) AS n, round(avg(abs(residual)), 4) AS mean_abs FROM e GROUP BY 1""")
def residual_cohorts(spark, sf_dir):
    return library.residual_cohorts(library.residual_fit(Given(spark, sf_dir).current, "rating_periods", "mu")).withColumn("mean_abs", r("mean_abs", 4))


@query(ODDS_SQL + CURRENT_SQL + """ SELECT count(*) FILTER (odds_data_quality = 'ok') AS covered, count(*) AS bouts, round(count(*) FILTER (odds_data_quality = 'ok') / count(*), 6) AS share,
  (SELECT count(DISTINCT f) FROM (SELECT fighter_a AS f FROM lines_ok WHERE odds_data_quality = 'ok' UNION ALL SELECT fighter_b FROM lines_ok WHERE odds_data_quality = 'ok')) AS fighters FROM lines_ok""")
def odds_coverage(spark, sf_dir):
    g = Given(spark, sf_dir)
    return library.odds_coverage(g.current, g.odds).withColumn("share", r("share"))


@query(""", m AS (SELECT ped_flagged_fighter AS f, 'ped' AS k FROM bouts WHERE ped_confirmed UNION ALL SELECT winner, 'dq' FROM bouts WHERE method_class = 'DQ' UNION ALL SELECT winner, 'weight' FROM bouts WHERE missed_weight AND missed_weight_fighter = winner)
SELECT f AS fighter, count(*) FILTER (k = 'ped') AS ped_confirmed_fights, count(*) FILTER (k = 'dq') AS dq_wins, count(*) FILTER (k = 'weight') AS missed_weight_wins FROM m WHERE f IS NOT NULL GROUP BY f""")
def integrity_counts(spark, sf_dir):
    return library.integrity_counts(Given(spark, sf_dir).bouts)


@query(CURRENT_SQL + """ SELECT recent_division AS division, CASE WHEN starts_with(recent_division, 'Women''s') THEN 'F' ELSE 'M' END AS gender, count(*) AS n FROM current GROUP BY 1, 2""")
def recent_divisions(spark, sf_dir):
    return snapshot.recent_divisions(Given(spark, sf_dir).bouts).groupBy(F.col("recent_division").alias("division"), "gender").agg(F.count(F.lit(1)).alias("n"))


@query(" SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, regexp_replace(event_type, '[^a-z]', '_', 'g') AS name FROM events", bouts=False)
def event_properties(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), clean.identifier(F.col("event_type")).alias("name"))
