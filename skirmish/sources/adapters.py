"""Bouts, rounds, odds and competitors derived from the sample star schema, so that every operator has input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: Column, *pairs: tuple[object, object]) -> Column:
    out = F.lit(None)
    for value, label in reversed(pairs):
        out = F.when(column == value, F.lit(label)).otherwise(out)
    return out


#: Part type to division, line flags to method of victory.
DIVISION_OF = (("STANDARD", "Lightweight"), ("ECONOMY", "Welterweight"), ("PROMO", "Women's Flyweight"), ("LARGE", "Heavyweight"), ("SMALL", "Flyweight"), ("MEDIUM", "Catch Weight"))
METHOD_OF = (("AF", "KO/TKO"), ("AO", "Submission"), ("NF", "Decision - Unanimous"), ("NO", "Decision - Split"), ("RF", "Decision - Majority"), ("RO", "DQ"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bout for each order with two suppliers: side a is its first line, side b the first later line of another one.

    One exchange and one sort on the order key serve all windows; orders and parts join afterwards.
    """
    # dealt out with plain columns: the structs below would carry most of them twice
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    line = line.withColumn("revenue", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    place = ("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "revenue", "l_returnflag", "l_linestatus")
    order = W.partitionBy("l_orderkey").orderBy(*place)
    till = order.rowsBetween(W.unboundedPreceding, 0)
    rows = line.select("l_orderkey", *place, F.row_number().over(order).alias("_n"), (F.col("l_suppkey") != F.first("l_suppkey").over(till)).alias("_other"))
    rows = rows.withColumn("_others", F.count_if(F.col("_other")).over(till)).where("_n = 1 or (_other and _others = 1)")  # both sides, one after the other
    sides = rows.select("l_orderkey", "_n", F.struct(*place).alias("a"), F.lead(F.struct(*place)).over(order).alias("b")).where("_n = 1 and b is not null").drop("_n")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("event_date"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    joined = sides.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("a.l_partkey") == F.col("p_partkey"))
    division = _case(F.col("p_type"), *DIVISION_OF)
    title = (F.col("o_orderpriority") == "1-URGENT") & (division != "Catch Weight")
    interim = title & (F.col("a.l_quantity") < 10)
    draw = (F.col("o_orderstatus") == "P") & (F.abs(F.col("a.l_quantity") - F.col("b.l_quantity")) <= 1)
    a, b = F.concat(F.lit("S"), F.col("a.l_suppkey")), F.concat(F.lit("S"), F.col("b.l_suppkey"))
    a_wins = F.col("a.revenue") > F.col("b.revenue")
    method = _case(F.concat("a.l_returnflag", "a.l_linestatus"), *METHOD_OF)
    low = 45 + F.col("a.l_suppkey") % 4
    return joined.select(
        F.col("l_orderkey").alias("bout_id"),
        "event_date",
        F.concat(F.lit("Card "), F.date_format("event_date", "yyyy-MM-dd")).alias("event_name"),
        a.alias("fighter_a"),
        b.alias("fighter_b"),
        F.when(~draw, F.when(a_wins, a).otherwise(b)).alias("winner"),
        F.when(~draw, F.when(a_wins, b).otherwise(a)).alias("loser"),
        draw.alias("is_draw"),
        division.alias("division"),
        F.when(interim, F.concat(F.lit("UFC Interim "), division, F.lit(" Title Bout"))).when(title, F.concat(F.lit("UFC "), division, F.lit(" Title Bout"))).otherwise(F.concat(division, F.lit(" Bout"))).alias("weight_class"),
        title.alias("is_title"),
        interim.alias("is_interim"),
        method.alias("method_class"),
        (1 + F.col("p_size") % 5).cast("int").alias("end_round"),
        (F.col("a.l_quantity") * 6).cast("int").alias("end_time_seconds"),
        F.when(title, "5 Rnd (5-5-5-5-5)").otherwise("3 Rnd (5-5-5)").alias("time_format"),
        F.concat(F.lit("50 - "), low.cast("string"), F.when(low == 47, ". 46 - 49. ").otherwise(". 49 - 46. "), F.when(low == 46, "47 - 47").otherwise(F.concat(F.lit("50 - "), (low - 1).cast("string"))), F.lit(".")).alias("details_text"),
        (F.col("o_orderpriority") == "5-LOW").alias("ped_confirmed"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.when(F.col("a.l_quantity") > 25, a).otherwise(b)).alias("ped_flagged_fighter"),
        (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("missed_weight"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.when(F.col("b.l_quantity") > 25, b).otherwise(a)).alias("missed_weight_fighter"),
        F.col("a.l_quantity").alias("qty_a"),
        F.col("b.l_quantity").alias("qty_b"),
    )


#: The same bouts in DuckDB's SQL, as the head of the oracles.
BOUTS_SQL = """
WITH lines AS (
  SELECT *, l_extendedprice * (1 - l_discount) AS revenue,
    row_number() OVER w AS rn, first_value(l_suppkey) OVER w AS lead_supp
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_quantity)
), side_b AS (
  SELECT l_orderkey, min(rn) AS rn FROM lines WHERE l_suppkey <> lead_supp GROUP BY l_orderkey
), raw AS (
  SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, CAST(o.o_orderdate AS DATE) AS event_date, p.p_size,
    CASE p.p_type WHEN 'STANDARD' THEN 'Lightweight' WHEN 'ECONOMY' THEN 'Welterweight' WHEN 'PROMO' THEN 'Women''s Flyweight'
      WHEN 'LARGE' THEN 'Heavyweight' WHEN 'SMALL' THEN 'Flyweight' ELSE 'Catch Weight' END AS division,
    a.l_suppkey AS sa, b.l_suppkey AS sb, a.l_quantity AS qty_a, b.l_quantity AS qty_b, a.revenue AS ra, b.revenue AS rb,
    'S' || a.l_suppkey AS fighter_a, 'S' || b.l_suppkey AS fighter_b, a.l_returnflag || a.l_linestatus AS flags
  FROM side_b JOIN lines b ON b.l_orderkey = side_b.l_orderkey AND b.rn = side_b.rn
  JOIN lines a ON a.l_orderkey = side_b.l_orderkey AND a.rn = 1
  JOIN orders o ON o.o_orderkey = side_b.l_orderkey JOIN part p ON p.p_partkey = a.l_partkey
), flagged AS (
  SELECT *, o_orderstatus = 'P' AND abs(qty_a - qty_b) <= 1 AS is_draw,
    o_orderpriority = '1-URGENT' AND division <> 'Catch Weight' AS is_title FROM raw
), bouts AS (
  SELECT o_orderkey AS bout_id, event_date, 'Card ' || strftime(event_date, '%Y-%m-%d') AS event_name, fighter_a, fighter_b,
    CASE WHEN NOT is_draw THEN CASE WHEN ra > rb THEN fighter_a ELSE fighter_b END END AS winner,
    CASE WHEN NOT is_draw THEN CASE WHEN ra > rb THEN fighter_b ELSE fighter_a END END AS loser,
    is_draw, division, is_title, is_title AND qty_a < 10 AS is_interim,
    CASE WHEN is_title AND qty_a < 10 THEN 'UFC Interim ' || division || ' Title Bout' WHEN is_title THEN 'UFC ' || division || ' Title Bout'
      ELSE division || ' Bout' END AS weight_class,
    CASE flags WHEN 'AF' THEN 'KO/TKO' WHEN 'AO' THEN 'Submission' WHEN 'NF' THEN 'Decision - Unanimous' WHEN 'NO' THEN 'Decision - Split'
      WHEN 'RF' THEN 'Decision - Majority' ELSE 'DQ' END AS method_class,
    CAST(1 + p_size % 5 AS INTEGER) AS end_round, CAST(qty_a * 6 AS INTEGER) AS end_time_seconds,
    CASE WHEN is_title THEN '5 Rnd (5-5-5-5-5)' ELSE '3 Rnd (5-5-5)' END AS time_format,
    '50 - ' || (45 + sa % 4) || CASE WHEN sa % 4 = 2 THEN '. 46 - 49. ' ELSE '. 49 - 46. ' END || CASE WHEN sa % 4 = 1 THEN '47 - 47' ELSE '50 - ' || (44 + sa % 4) END || '.' AS details_text,
    o_orderpriority = '5-LOW' AS ped_confirmed,
    CASE WHEN o_orderpriority = '5-LOW' THEN CASE WHEN qty_a > 25 THEN fighter_a ELSE fighter_b END END AS ped_flagged_fighter,
    o_orderpriority = '4-NOT SPECIFIED' AS missed_weight,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE WHEN qty_b > 25 THEN fighter_b ELSE fighter_a END END AS missed_weight_fighter,
    qty_a, qty_b
  FROM flagged
), seqs AS (
  SELECT event_date, event_name, dense_rank() OVER (ORDER BY event_date, event_name) AS event_seq FROM (SELECT DISTINCT event_date, event_name FROM bouts)
), apps AS (
  SELECT b.bout_id, b.event_date, b.event_name, e.event_seq, s.side, CASE s.side WHEN 'a' THEN fighter_a ELSE fighter_b END AS fighter,
    CASE s.side WHEN 'a' THEN fighter_b ELSE fighter_a END AS opponent, b.winner, b.is_draw, b.division, b.is_title, b.is_interim, b.method_class,
    coalesce(b.winner = CASE s.side WHEN 'a' THEN fighter_a ELSE fighter_b END, false) AS is_winner
  FROM bouts b JOIN seqs e USING (event_date, event_name) CROSS JOIN (VALUES ('a'), ('b')) s(side)
), history AS (
  SELECT fighter, event_date, event_name, event_seq,
    1500 + 12 * sum(sum(CASE WHEN is_winner THEN 1 WHEN is_draw THEN 0 ELSE -1 END)) OVER (PARTITION BY fighter ORDER BY event_seq)
      + 0.5 * (CAST(substr(fighter, 2) AS INTEGER) % 7) AS mu
  FROM apps GROUP BY fighter, event_date, event_name, event_seq
)"""


def sequenced(bouts: DataFrame) -> DataFrame:
    """Bouts with event_seq, the rank of their event. Events are few beside bouts: the rank is taken over the distinct ones and joined back."""
    events = bouts.select("event_date", "event_name").distinct()
    return bouts.join(F.broadcast(events.withColumn("event_seq", F.dense_rank().over(W.orderBy("event_date", "event_name")))), ["event_date", "event_name"])


def surrogate_history(appearances: DataFrame) -> DataFrame:
    """A rating after each event that SQL can compute too: 1500, 12 for each win more than losses, and a little by name."""
    result = F.when(F.col("is_winner"), 1).when(F.col("is_draw"), 0).otherwise(-1)
    per_event = appearances.groupBy("fighter", "event_date", "event_name", "event_seq").agg(F.sum(result).alias("net"))
    run = F.sum("net").over(W.partitionBy("fighter").orderBy("event_seq"))
    return per_event.select("fighter", "event_date", "event_name", "event_seq", (1500 + 12 * run + 0.5 * (F.substring("fighter", 2, 9).cast("int") % 7)).alias("mu"))


def odds(spark: SparkSession, sf_dir: str, bouts: DataFrame) -> DataFrame:
    """Raw odds for each bout: American from the suppliers' balances, decimal where the balance is low, none for some."""
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("name"), "s_acctbal")
    joined = bouts.select("bout_id", "fighter_a", "fighter_b", "winner", "is_draw", "event_date")
    for side in "ab":
        joined = joined.join(supplier.select(F.col("name").alias(f"fighter_{side}"), F.col("s_acctbal").alias(f"bal_{side}")), f"fighter_{side}")
    # stored with the rounded edge: else each of the many expressions above would round anew, and filters on them pass an exchange
    joined = cut(joined.withColumn("edge", F.round((F.col("bal_a") - F.col("bal_b")) / 20, 0)), "edges")
    edge = F.col("edge")
    line = F.when(edge >= 0, -100 - edge).otherwise(100 - edge)
    return joined.select(
        "bout_id", "fighter_a", "fighter_b", "winner", "is_draw", "event_date",
        F.when(F.col("bout_id") % 11 != 0, line).alias("american_odds_a"),
        F.when(F.col("bout_id") % 7 != 0, F.when(edge >= 0, 80 + edge).otherwise(-120 + edge)).alias("american_odds_b"),
        F.when(F.col("bout_id") % 11 == 0, 1 + F.abs(F.col("bal_b")) / 1000).alias("decimal_odds_a"),
        F.when(F.col("bout_id") % 14 == 0, 1 + F.abs(F.col("bal_a")) / 1000).alias("decimal_odds_b"),
    )


ODDS_SQL = """, odds AS (
  SELECT b.bout_id, b.fighter_a, b.fighter_b, b.winner, b.is_draw, b.event_date,
    CASE WHEN b.bout_id % 11 <> 0 THEN CASE WHEN edge >= 0 THEN -100 - edge ELSE 100 - edge END END AS american_odds_a,
    CASE WHEN b.bout_id % 7 <> 0 THEN CASE WHEN edge >= 0 THEN 80 + edge ELSE -120 + edge END END AS american_odds_b,
    CASE WHEN b.bout_id % 11 = 0 THEN 1 + abs(bal_b) / 1000 END AS decimal_odds_a,
    CASE WHEN b.bout_id % 14 = 0 THEN 1 + abs(bal_a) / 1000 END AS decimal_odds_b
  FROM (SELECT b.*, x.s_acctbal AS bal_a, y.s_acctbal AS bal_b, round((x.s_acctbal - y.s_acctbal) / 20, 0) AS edge
    FROM bouts b JOIN supplier x ON b.fighter_a = 'S' || x.s_suppkey JOIN supplier y ON b.fighter_b = 'S' || y.s_suppkey) b
), priced AS (
  SELECT *, coalesce(CASE WHEN american_odds_a > 0 THEN 100 / (american_odds_a + 100) WHEN american_odds_a < 0 THEN american_odds_a / (american_odds_a - 100) END,
      CASE WHEN decimal_odds_a > 1 THEN 1 / decimal_odds_a END) AS raw_a,
    coalesce(CASE WHEN american_odds_b > 0 THEN 100 / (american_odds_b + 100) WHEN american_odds_b < 0 THEN american_odds_b / (american_odds_b - 100) END,
      CASE WHEN decimal_odds_b > 1 THEN 1 / decimal_odds_b END) AS raw_b FROM odds
), lines_ok AS (
  SELECT *, CASE WHEN raw_a IS NULL AND raw_b IS NULL THEN 'missing' WHEN raw_a IS NULL OR raw_b IS NULL THEN 'one_side_missing'
      WHEN raw_a + raw_b < 0.85 THEN 'negative_vig' WHEN raw_a + raw_b > 2 THEN 'implausible' ELSE 'ok' END AS odds_data_quality,
    raw_a / (raw_a + raw_b) AS prob_a, raw_b / (raw_a + raw_b) AS prob_b FROM priced
)"""


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round statistics of each bout's two sides: an order's lines, numbered, with three numbers each."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        F.col("l_orderkey").alias("bout_id"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("fighter"), F.col("l_linenumber").alias("round_num"),
        F.col("l_quantity").alias("sig_str_landed"), F.round(F.col("l_discount") * 100, 0).alias("sub_att"), F.round(F.col("l_tax") * 1000, 0).alias("ctrl_seconds"),
    )


def ranking_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with a ranking table for each nation and division, made of the suppliers, ages left out for every third one."""
    c = F.col
    name = F.concat(F.lit("S"), c("s_suppkey"), F.when(c("s_suppkey") % 3 != 0, F.concat(F.lit(" ("), (20 + c("s_suppkey") % 15).cast("int"), F.lit(")"))).otherwise(""))
    cells = F.format_string("<tr><td>%d</td><td><a href='/fighter-profile/%d/'>%s</a></td><td>3-1-0</td><td>%d</td></tr>", (c("s_suppkey") % 20 + 1).cast("int"), c("s_suppkey").cast("long"), name, (c("s_suppkey") * 2).cast("long"))
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.when(c("s_nationkey") % 2 == 0, "Lightweight").otherwise("Flyweight").alias("division"), cells.alias("row"))
    page = F.concat(F.lit("<html><table class='menu'><tr><td>1</td></tr></table><table class='tblRank'><tr><th>Rank</th></tr>"), F.array_join(F.array_sort(F.collect_list("row")), ""), F.lit("</table></html>"))
    return rows.groupBy("s_nationkey", "division").agg(page.alias("html")).select("division", "html")
