"""Sharding: contiguous shards of near equal bytes, from global prefix sums (DataFrame operations alone).

Rows are dealt to partitions by range of the order, each partition's total is summed, and a running sum over
the few totals gives every partition the bytes that stand before it. A row's shard is the equal target that its
middle byte falls into, so a cut is off its target by half a row at most.

Edge cases: a null text has no bytes and so size 1; rows with equal keys keep apart by their place in the input;
an empty table gives an empty result; columns `shard` and `slot` of the input give way, all others stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_name, read_table, stored

SHARDS = 16


def shard_by_bytes(rows: DataFrame, size_col: str, order_by: list[str], n_shards: int = SHARDS) -> DataFrame:
    """`rows` with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), in the order of `order_by`.

    Memory: no row but the partitions' totals and the shards' first places is ever broadcast: one row for each
    shuffle partition and one for each shard, whatever the input.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("shard", "slot")])
    pid, tie, bytes0, rows0, total, end, rank, first = (fresh_name(rows, c) for c in ("pid", "tie", "bytes0", "rows0", "total", "end", "rank", "first"))
    by = [*[F.col(c).asc_nulls_first() for c in order_by], F.col(tie)]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).withColumn(pid, F.spark_partition_id())
    dealt = stored(dealt, "shard-ranges")
    totals = dealt.groupBy(pid).agg(F.sum(size_col).alias(bytes0), F.count(F.lit(1)).alias(rows0))
    before, all_ = W.orderBy(pid).rowsBetween(W.unboundedPreceding, -1), W.orderBy(pid).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    totals = totals.select(pid, F.coalesce(F.sum(bytes0).over(before), zero).alias(bytes0), F.coalesce(F.sum(rows0).over(before), zero).alias(rows0), F.sum(bytes0).over(all_).alias(total))
    run = W.partitionBy(pid).orderBy(*by)
    placed = (
        dealt.join(F.broadcast(totals), pid)
        .withColumn(end, F.col(bytes0) + F.sum(size_col).over(run))
        .withColumn(rank, F.col(rows0) + F.row_number().over(run) - 1)
        .withColumn("shard", F.expr(f"cast(least({n_shards - 1}, ((2 * {end} - `{size_col}`) * {n_shards}) div (2 * {total})) as int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min(rank).alias(first))
    out = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col(rank) - F.col(first))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write rows that carry shard and slot as one folder for each shard, in slot order inside each file."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shard_by_bytes(docs, "size", ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB: the same cuts. A CRC is folded over the bytes with list functions, a bit at a time through a table of 256.
SQL = """
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (
  SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM (SELECT doc_id, size, hex(encode(text)) AS h FROM d), tab
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS e,
         sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS r FROM c
), p AS (
  SELECT *, least(15, ((2 * e - size) * 16) // (2 * total))::INTEGER AS shard FROM s
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard,
       (r - min(r) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""
