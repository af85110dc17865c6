"""Helpers that the training-data operators share: reading, cutting lineage, hashing, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so batches are kept small.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20
#: Bytes of a stored table's row group: a task that writes or reads one holds it whole.
GROUP_BYTES = 16 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, runs of anything but space and \\x09-\\x0D (what bytes.split() parts at)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, by any path that Spark can read."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Small batches, of Arrow's and of the Parquet reader's, so that a Python worker and a task hold few whole texts at a time."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one where it names none and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "skirmish-checkpoints")
    sc.setCheckpointDir(named)
    return named


#: Spark's setting by which the shuffle files of an action go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder. The shuffle files behind it go once it stands."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**{"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "8"}).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@cache
def _trim():
    """The C library's malloc_trim, if it has one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def release() -> None:
    """Hand freed memory back to the system: workers are kept for later tasks, and what they hold on to adds up."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def released(run):
    """A map over batches that hands its memory back when it ends."""

    def passing(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return passing


def dropped(*tables: DataFrame) -> None:
    """Take stored tables away that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers (splitmix64's)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHashes:
    """64-bit hashes of words; repeated words are looked up. The table is emptied when it is full, so memory is bounded."""

    def __init__(self, most: int = 150_000):
        import xxhash

        self._digest, self._most, self._known = xxhash.xxh3_64_intdigest, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        out = list(map(known.get, words))
        if None in out:
            digest = self._digest
            for i, v in enumerate(out):
                if v is None:
                    w = words[i]
                    if (v := known.get(w)) is None:
                        if len(known) >= self._most:
                            known.clear()
                        known[w] = v = digest(w) - 2**63
                    out[i] = v
        return np.fromiter(out, np.int64, len(out)).view(np.uint64)


def groups_of(texts: list[str | None], most: int = 1 << 20):
    """(start, end) of runs of texts of about `most` characters, so that long texts don't add up in memory."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[str | None], n: int, words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its n-word shingles, one after another, and their counts.

    A text of fewer words is one shingle; one without words has none.
    """
    held: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        found = words_of(t)
        counts[i] = len(found)
        held += found
    h = words(held)
    del held
    ends = np.cumsum(counts)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    # places where a shingle starts
    first = np.repeat(ends - counts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    at = first + np.arange(len(first))
    acc = np.full(len(at), np.uint64(0x9E3779B97F4A7C15), np.uint64)
    left = np.repeat(ends, sizes) - at
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    for j in range(n):
        acc = mix64(acc + np.where(left > j, padded[at + j] | np.uint64(1), np.uint64(0)))
    stops = np.cumsum(sizes).tolist()
    for a, b in zip([0, *stops], stops):
        acc[a:b].sort()
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(acc):
        keep = np.ones(len(acc), bool)
        keep[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
        acc, owner = acc[keep], owner[keep]
    return acc, np.bincount(owner, minlength=len(texts))


def runs(batches, width: int):
    """Rows of sorted Arrow batches in runs that agree in the first `width` columns."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if held:
                    yield held
                held, key = [], row[:width]
            held.append(row)
    if held:
        yield held


#: Parts that the rows of one root are dealt into when labels jump.
SALTS = 16


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node that each node of `edges` can reach: columns node, root.

    Labels spread along the edges and then jump to their label's label, so the rounds grow with the
    logarithm of a component's width. Each round is stored, the one before goes, and only a count comes to the driver.
    A root that many nodes share is looked up in SALTS parts.
    """
    both = edges.select(F.col(a).alias("s"), F.col(b).alias("d"))
    both = stored(both.union(both.select(F.col("d").alias("s"), F.col("s").alias("d"))).where("s != d").distinct(), "edges")
    labels = stored(both.groupBy(F.col("s").alias("node")).agg(F.min("d").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("d"), "root"), "d").groupBy(F.col("s").alias("node")).agg(F.min("root").alias("m"))
        spread = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
        roots = labels.select("root").distinct()  # after a jump each new root was some node's root before
        jump = labels.join(roots.withColumnRenamed("root", "node"), "node", "left_semi").select(F.col("node").alias("root"), F.col("root").alias("up"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        new = stored(spread.join(jump, ["root", "salt"]).select("node", "old", F.least("root", "up").alias("root")), "labels")
        done = not new.where("old != root").limit(1).count()
        dropped(labels, *[both] * done)
        if done:
            return new.select("node", "root")
        labels = new.select("node", "root")
