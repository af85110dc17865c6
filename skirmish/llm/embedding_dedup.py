"""Near-duplicates among embeddings by randomised-rotation binary codes.

Every vector is turned by random rotations and coded by the signs; with each code goes its correction factor, the
inner product of the vector and its own code. <code, q> / factor then estimates <vector, q> without bias, and the
error is below eps * sqrt((1 - factor^2) / factor^2) / sqrt(D - 1) but for a chance that falls with exp(-eps^2 / 2)
(Gao and Long 2024). A pair whose upper bound stays below the threshold is done with; only the others are computed
exactly, in double precision.

Pairs are looked for in buckets of code bits: bits and tables grow with the number of vectors so that buckets stay
small and a pair at the threshold meets in one table at least with a probability of RECALL. Buckets hold codes and
8-bit vectors alone. Vectors whose bounds don't part them become one cluster, and each cluster's whole vectors are
fetched once and compared exactly, in pairs of blocks where a cluster is large. Equal vectors are one from the
start, and a bucket gives only enough pairs to join what its bounds don't part, never all pairs of a group.

Edge cases: vectors that are null, empty or zero or hold null or non-finite components link with nothing and are
kept; vectors of different length never link; rows with equal or null ids are each returned; of linked rows with one
smallest id all of that id are kept; columns other than the id and the vector are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import connected_components, dropped, mix64, read_table, runs, stored

#: Least probability that a pair at the threshold meets in a bucket; the bound's width; bits of a code at least.
RECALL, EPS, CODE_BITS = 0.995, 3.0, 256
#: Vectors of a cluster that are compared in one piece of work; vectors of a bucket that one piece of work takes; pairs whose bounds are
#: computed at once; vectors of a bucket up to which all pairs are looked at together.
BLOCK, BUCKET, PAIRS, SMALL = 256, 8192, 4096, 48


def layout(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket's key and number of tables, for n vectors."""
    bits = min(40, max(6, math.ceil(math.log2(max(2, n))) - 3))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - meet)))


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, which: int) -> np.ndarray:
    """A random rotation, the same one everywhere for a dimension and a number."""
    if (dim, which) not in _ROTATIONS:
        if len(_ROTATIONS) > 64:
            _ROTATIONS.clear()
        q, r = np.linalg.qr(np.random.default_rng([dim, which]).standard_normal((dim, dim)))
        _ROTATIONS[dim, which] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, which]


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes [n, rotations, dim] as -1 and 1, and correction factors [n, rotations], of unit vectors."""
    dim = x.shape[1]
    turned = np.stack([x @ rotation(dim, r).T for r in range(math.ceil(CODE_BITS / dim))], 1)
    return np.where(turned > 0, 1, -1).astype(np.int8), np.abs(turned).sum(2) / math.sqrt(dim)


def upper_bounds(code: np.ndarray, factor: np.ndarray, q: np.ndarray, q_error: np.ndarray) -> np.ndarray:
    """Upper bounds of <vector, q>, by rows; `q_error` is the length by which q may be off."""
    dim, many = code.shape[2], code.shape[1]
    est = 0.0
    for r in range(many):
        est = est + (code[:, r] * (q @ rotation(dim, r).T)).sum(1) / (math.sqrt(dim) * factor[:, r])
    f = factor.mean(1)
    width = EPS * np.sqrt((1 - f**2).clip(0) / f**2) / math.sqrt(max(1, (dim - 1) * many))
    return est / many + width + q_error / f


def _unit(batch_column) -> list[np.ndarray]:
    out = []
    for v in batch_column.to_pylist():
        a = np.array(v, np.float64)
        out.append(a / math.sqrt(a @ a))
    return out


def _keyed(bits: int, tables: int):
    """(cid, vector) to cid and its bucket keys, one a table."""

    def run(batches):
        for batch in batches:
            cids, vectors = batch.column(0).to_numpy(), _unit(batch.column(1))
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.stack([vectors[i] for i in at])
                signs = [(x @ rotation(int(dim), 1000 + r).T > 0) for r in range(math.ceil(bits * tables / dim))]
                signs = np.concatenate(signs, 1)[:, : bits * tables].reshape(len(at), tables, bits)
                value = (signs.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(2, dtype=np.uint64)
                key = mix64(value + (np.arange(tables, dtype=np.uint64) << np.uint64(44)) + (np.uint64(dim) << np.uint64(52))).view(np.int64)
                yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(cids[at], tables))], ["key", "cid"])

    return run


def _coded(batches):
    """(cid, vector) to cid, dim, packed codes, factors, 8-bit vector and its scale."""
    for batch in batches:
        cids, vectors = batch.column(0).to_numpy(), _unit(batch.column(1))
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = np.stack([vectors[i] for i in at])
            code, factor = codes(x)
            scale = np.abs(x).max(1) / 127
            small = np.rint(x / scale[:, None]).astype(np.int8)
            packed = np.packbits(code.reshape(len(at), -1) > 0, axis=1)
            yield pa.record_batch([
                pa.array(cids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array([c.tobytes() for c in packed], pa.binary()),
                pa.array([f.astype(np.float32).tobytes() for f in factor], pa.binary()), pa.array([v.tobytes() for v in small], pa.binary()), pa.array(scale),
            ], ["cid", "dim", "code", "factor", "small", "scale"])


class _Bucket:
    """The vectors of one bucket, with bounds between any two of them."""

    def __init__(self, rows):
        dim = rows[0][2]
        self.cid = np.array([r[1] for r in rows])
        raw = np.unpackbits(np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
        many = math.ceil(CODE_BITS / dim)
        self.code = raw[:, : many * dim].reshape(len(rows), many, dim).astype(np.int8) * 2 - 1
        self.factor = np.frombuffer(b"".join(r[4] for r in rows), np.float32).reshape(len(rows), many).astype(float)
        scale = np.array([r[6] for r in rows])
        self.q = np.frombuffer(b"".join(r[5] for r in rows), np.int8).reshape(len(rows), dim) * scale[:, None]
        self.error = scale / 2 * math.sqrt(dim)

    def close(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        out = np.empty(len(i), bool)
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            out[k : k + PAIRS] = upper_bounds(self.code[a], self.factor[a], self.q[b], self.error[b]) >= threshold
        return out

    def edges(self, threshold: float):
        """Pairs that join all vectors whose bounds don't part them: fewer than there are vectors."""
        every, group = np.arange(len(self.cid)), np.arange(len(self.cid))

        def joined(k, h):
            group[group == group[h]] = group[k]
            return int(self.cid[k]), int(self.cid[h])

        if len(every) <= SMALL:  # few enough for one look at all pairs
            i, j = np.triu_indices(len(every), 1)
            for k in np.flatnonzero(self.close(i, j, threshold)):
                if group[i[k]] != group[j[k]]:
                    yield joined(i[k], j[k])
            return
        for k in every:
            if k and group[k] == group[0]:
                continue  # what the first vector took in is met by the others
            others = every[group != group[k]]
            hit = others[self.close(np.full(len(others), k), others, threshold)]
            _, first = np.unique(group[hit], return_index=True)
            for h in hit[first]:
                yield joined(k, h)


def _bucketed(threshold: float):
    def run(batches):
        out: list[tuple[int, int]] = []
        for rows in runs(batches, 3):
            for edge in _Bucket([r[2:] for r in rows]).edges(threshold) if len(rows) > 1 else ():
                out.append(edge)
            if len(out) > 20_000:
                yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])
                out = []
        yield pa.record_batch([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    return run


def _exact(threshold: float):
    """(root, i, j, block, cid, mult, vector) sorted by root, i, j to (cid, links found here, smallest cid linked here)."""

    def run(batches):
        for rows in runs(batches, 3):
            x = np.stack(_unit(pa.array([r[6] for r in rows])))
            cid, mult = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            block = np.array([r[3] for r in rows])
            link = x @ x.T >= threshold
            np.fill_diagonal(link, False)
            if rows[0][1] != rows[0][2]:  # two different blocks: pairs across alone
                link &= block[:, None] != block[None, :]
            root = cid.copy()
            while True:  # smallest cid within the links found here
                new = np.minimum(root, np.where(link, root[None, :], np.iinfo(np.int64).max).min(1))
                if (new == root).all():
                    break
                root = new
            yield pa.record_batch([pa.array(cid), pa.array(link @ mult), pa.array(root)], ["cid", "links", "root"])

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: id, n_links, component_id (smallest id reachable) and kept."""
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_col).alias("id"), v.alias("vector"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.select("id", "vector", F.when(F.col("sound"), F.xxhash64("vector")).alias("h1"), F.when(F.col("sound"), F.xxhash64(F.lit(1), "vector")).alias("h2"), F.monotonically_increasing_id().alias("row"))
    of_class = [F.min("row").alias("cid"), F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"), F.first("vector").alias("vector")]
    classes = stored(rows.where("h1 is not null").groupBy("h1", "h2").agg(*of_class), "vector-classes")
    n = classes.count()
    bits, tables = layout(n, threshold)

    # First the keys alone move; codes and 8-bit vectors only meet buckets of two and more.
    by_key = W.partitionBy("key")
    index = classes.select("cid", "vector").mapInArrow(_keyed(bits, tables), "key long, cid long")
    index = index.withColumn("many", F.count(F.lit(1)).over(by_key)).where("many > 1")
    # Buckets beyond BUCKET vectors are dealt out in pairs of blocks.
    blocks = F.ceil(F.col("many") / BUCKET).cast("long")
    index = index.select("key", "cid", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).alias("block"))
    index = index.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    coded = stored(classes.select("cid", "vector").mapInArrow(_coded, "cid long, dim int, code binary, factor binary, small binary, scale double"), "vector-codes")
    index = index.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "cid").join(coded, "cid")
    edges = index.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid").select("key", "i", "j", "cid", "dim", "code", "factor", "small", "scale")
    edges = edges.mapInArrow(_bucketed(threshold), "a long, b long").distinct()
    edges = stored(edges, "vector-edges")
    dropped(coded)
    clusters = connected_components(edges)
    dropped(edges)

    sized = clusters.join(clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")), "root")
    members = sized.join(classes.select(F.col("cid").alias("node"), "mult", "vector"), "node")
    members = members.select("root", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.col("node").alias("cid"), "mult", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    work = members.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "mult", "vector")
    work = work.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "cid")
    found = stored(work.mapInArrow(_exact(threshold), "cid long, links long, root long"), "vector-links")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")))

    known = classes.select("h1", "h2", "cid", "least", "mult").join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    known = known.withColumn("root", F.coalesce("root", "cid"))
    known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    out = rows.select("id", "h1", "h2").join(known.select("h1", "h2", "mult", "links", "component_id"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", (F.coalesce("mult", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: DuckDB: cosines of all pairs of different vectors, then what each vector reaches. Equal vectors are one class.
SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS x, md5(embedding::VARCHAR) AS cid,
         coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda y: coalesce(isfinite(y), false))) = len(embedding)
                  AND len(list_filter(embedding, lambda y: y <> 0)) > 0, false) AS sound FROM embeddings
), c AS MATERIALIZED (
  SELECT cid, x, len(x) AS dim, mult, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm
  FROM (SELECT cid, any_value(x) AS x, count(*) AS mult FROM v WHERE sound GROUP BY cid)
), e AS MATERIALIZED (
  SELECT a.cid AS a, b.cid AS b, b.mult FROM c a JOIN c b ON a.dim = b.dim AND a.cid <> b.cid
  WHERE CASE WHEN a.dim = b.dim THEN list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95 END
), reach AS (
  SELECT cid, cid AS other FROM c UNION SELECT r.cid, e.b FROM reach r JOIN e ON r.other = e.a
), k AS (
  SELECT r.cid, min(v.vec_id) AS component_id FROM reach r JOIN v ON r.other = v.cid GROUP BY r.cid
), n AS (
  SELECT c.cid, (c.mult - 1 + coalesce((SELECT sum(e.mult) FROM e WHERE e.a = c.cid), 0))::BIGINT AS n_links FROM c
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(k.component_id, v.vec_id) AS component_id,
       v.vec_id = coalesce(k.component_id, v.vec_id) AS kept
FROM v LEFT JOIN k ON v.sound AND v.cid = k.cid LEFT JOIN n ON v.sound AND v.cid = n.cid
"""
