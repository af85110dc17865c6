"""Running totals over all rows, and components of a graph, without any task that holds them all."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import cut, dropped


@cache
def _trim():
    """The C library's malloc_trim, if it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def released(run):
    """A map over batches that hands its memory back to the system when it ends: workers are kept for later tasks, and stand beside them."""

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return passing


def totals_before(rows: DataFrame, order: Column, value: str) -> DataFrame:
    """`rows` with `_before`, the sum of `value` in all rows that come earlier in `order`, and `_all`, the sum of all.

    Rows are dealt by range and stored; the running sum over the ranges' totals is a window over one row a partition.
    """
    dealt = cut(rows.repartitionByRange(order).withColumn("_pid", F.spark_partition_id()), "ranges")
    zero = F.lit(0).cast("long")
    ranges = dealt.groupBy("_pid").agg(F.sum(value).alias("_sum"))
    ranges = ranges.select("_pid", F.coalesce(F.sum("_sum").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), zero).alias("_base"), F.sum("_sum").over(W.partitionBy()).alias("_all"))
    here = F.sum(value).over(W.partitionBy("_pid").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return dealt.withColumn("_here", F.coalesce(here, zero)).join(F.broadcast(ranges), "_pid").withColumn("_before", F.col("_base") + F.col("_here")).drop("_pid", "_base", "_here")


def _forest(batches):
    """Rows (s, d) of one task to a few of them that join the same names."""
    root: dict[str, str] = {}

    def top(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        met = batch.to_pandas().drop_duplicates()
        kept = []
        for s, d in zip(met["s"], met["d"], strict=True):
            if (x := top(s)) != (y := top(d)):
                root[x] = y
                kept.append((s, d))
            elif s == d:
                kept.append((s, d))
        if kept:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*kept, strict=True)], ["s", "d"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The least name that each name of `edges` is joined with, over any number of edges: columns name, pool.

    Names take the least label around them and then their label's label, so the rounds grow with the logarithm of a
    component's width; each round is stored, and only whether labels moved comes to the driver. Before that, each task
    keeps of its edges a forest that joins the same names.
    """
    edges = edges.select(F.col(a).alias("s"), F.col(b).alias("d")).where("s is not null and d is not null").mapInArrow(released(_forest), "s string, d string")
    both = cut(edges.select(F.explode(F.array(F.struct("s", "d"), F.struct(F.col("d").alias("s"), F.col("s").alias("d")))).alias("e")).select("e.*").distinct(), "edges")
    labels = cut(both.groupBy(F.col("s").alias("name")).agg(F.min("d").alias("d")).select("name", F.least("name", "d").alias("pool")), "pools")
    while True:
        around = both.join(labels.select(F.col("name").alias("d"), "pool"), "d").groupBy(F.col("s").alias("name")).agg(F.min("pool").alias("near"))
        spread = labels.join(around, "name").select("name", F.col("pool").alias("old"), F.least("pool", "near").alias("pool"))
        up = labels.select(F.col("name").alias("pool"), F.col("pool").alias("up"))
        new = cut(spread.join(up, "pool").select("name", "old", F.least("pool", "up").alias("pool")), "pools")
        done = new.where("old <> pool").isEmpty()
        dropped(labels)
        labels = new.select("name", "pool")
        if done:
            dropped(both)
            return labels
