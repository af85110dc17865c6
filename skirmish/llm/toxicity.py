"""Toxicity by maximum-scoring segments.

Each word has a log-odds score: its rate in toxic against other labelled texts under a Dirichlet prior. The prior's
mean comes from the word's first six letters, theirs from the first four, theirs from the whole corpus, so that
words of one stem share evidence. A drift makes ordinary words negative. Ruzzo and Tompa's linear scan finds all
maximal scoring segments of a text; Karlin and Altschul's law turns a segment's score into the expected number of
segments as good in ordinary text of the same length; the segments with few expected are the toxic passages. A
logistic curve over the best segment and the number of significant ones gives the score.

Counts live in two hashed tables of fixed size (the lesser count holds), 32 MB in all, so what is broadcast never grows
with the corpus; rare words of a very large vocabulary blur, held back by the prior. Counts and the background cover all labelled training texts, equal texts counted once; the logistic curve
is fitted on about `FIT_ROWS` of them, twice as many at most.

Edge cases: null and empty texts have no segment and get the curve's value at nothing; without labels of both kinds
all scores are 0; unlabelled rows and rows with null labels teach nothing; rows repeat as they are; extra columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read_table, released, stored

#: ASCII characters other than letters and digits part words.
_PARTS = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
STEMS = (4, 6)
#: Buckets of each hashed table; strength of the prior, in words; what is taken off every score.
BUCKETS, STRENGTH, DRIFT = 1 << 20, 12.0, 0.5
#: Rows that the logistic curve is fitted on, about.
FIT_ROWS = 50_000
#: Bins of the background's histogram of scores, and their width.
BINS, WIDTH = 400, 0.05
#: A segment counts as significant when fewer than this many as good are expected by chance.
SIGNIFICANT = 0.05


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).split() if text else []


def features(word: str) -> list[str]:
    """The word and its stems, the longest first, each marked by its kind."""
    out = ["w" + word]
    for n in reversed(STEMS):
        if len(word) > n:
            out.append(f"{n}{word[:n]}")
    return out


def _places(feature: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass"))
    return h % BUCKETS, BUCKETS + (h >> 32) % BUCKETS


def _packed(batches):
    """(id, text) to (id, compressed text)."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(blobs, pa.binary())], ["id", "blob"])


def _texts(column):
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for blob in column.to_pylist():
        yield unpack.decompress(blob).decode("utf-8", "surrogatepass")


#: Words that a task counts before it adds them to its buckets.
_TALLIED = 200_000


def _count(batches):
    """(blob, toxic) to the counts of each bucket in the task. A word counts once a text: repeats are no further evidence."""
    sums = np.zeros((2, 2 * BUCKETS), np.int64)
    tallies: tuple[Counter, Counter] = Counter(), Counter()

    def emptied():
        for which, tally in enumerate(tallies):
            for word, k in tally.items():
                for f in features(word.decode("utf-8", "surrogatepass")):
                    for at in _places(f):
                        sums[0, at] += k
                        if which:
                            sums[1, at] += k
            tally.clear()

    for batch in batches:
        for text, toxic in zip(_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            tallies[bool(toxic)].update(set(words_of(text)))
            if len(tallies[0]) + len(tallies[1]) > _TALLIED:
                emptied()
    emptied()
    at = np.flatnonzero(sums[0])
    for k in range(0, len(at), 100_000):
        part = at[k : k + 100_000]
        yield pa.record_batch([pa.array(part), pa.array(sums[0, part]), pa.array(sums[1, part])], ["bucket", "n", "t"])


class Model(dict):
    """Scores of words (UTF-8), from the two tables of counts; looked up words are kept, up to a bound."""

    def __init__(self, n: np.ndarray, t: np.ndarray, base: float):
        self.n, self.t, self.base = memoryview(n), memoryview(t), base
        self.stems: dict[str, float] = {}
        self.zero = math.log(base / (1 - base)) + DRIFT

    def rate(self, feature: str, prior: float) -> float:
        """Share of toxic texts among those with the feature, drawn to the prior's."""
        a, b = _places(feature)
        if self.n[b] < self.n[a]:
            a = b
        return (self.t[a] + STRENGTH * prior) / (self.n[a] + STRENGTH)

    def stem(self, stems: list[str]) -> float:
        if not stems:
            return self.base
        if (out := self.stems.get(stems[0])) is None:
            if len(self.stems) > 200_000:
                self.stems.clear()
            self.stems[stems[0]] = out = self.rate(stems[0], self.stem(stems[1:]))
        return out

    def __missing__(self, word: bytes) -> float:
        whole, *stems = features(word.decode("utf-8", "surrogatepass"))
        rate = self.rate(whole, self.stem(stems))
        if len(self) > 250_000:
            self.clear()
        self[word] = out = math.log(rate / (1 - rate)) - self.zero
        return out

    def scores(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) of a sequence, in linear time (Ruzzo and Tompa 1999)."""
    if not len(scores):
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    up = scores > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], up.view(np.int8), [0]))))
    held: list[tuple[float, float, int, int]] = []  # sum before, sum at end, start, end
    lefts: list[int] = []  # for each, the nearest earlier one whose sum before is less
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        lo, hi = total[a], total[b]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= lo:
                j = lefts[j]
            if j < 0 or held[j][1] >= hi:
                held.append((lo, hi, a, b))
                lefts.append(j)
                break
            lo, a = held[j][0], held[j][2]
            del held[j:], lefts[j:]
    return [(float(h - lo), a, b) for lo, h, a, b in held]


class Chance:
    """How many segments of a score or better are expected in ordinary text: K * length * exp(-rate * score)."""

    def __init__(self, counts: np.ndarray):
        mids = (np.arange(BINS) - BINS // 2 + 0.5) * WIDTH
        p = counts / max(1, counts.sum())
        self.rate = 1.0
        if (p * mids).sum() < 0 and p[mids > 0].any():
            lo, hi = 0.0, 20.0
            for _ in range(60):  # the positive root of E[exp(rate * score)] = 1
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * mids, 50))).sum() < 1 else (lo, mid)
            self.rate = max(lo, 0.05)
        # share of places where a segment can begin: those with a positive score
        self.k = max(float(p[mids > 0].sum()), 1e-6)

    def surprise(self, score: float, length: int) -> float:
        """-ln of that number."""
        return self.rate * score - math.log(self.k * max(1, length))


def summary(model: Model, chance: Chance, text: str | None) -> tuple[float, int, int, int]:
    """-ln of the best segment's expected number (at least 0), number of significant segments, the best one's bounds."""
    s = model.scores(text)
    found = segments(s)
    if not found:
        return 0.0, 0, 0, 0
    score, start, end = max(found, key=lambda x: (x[0], -x[1]))
    best = chance.surprise(score, len(s))
    if best <= 0:
        return 0.0, 0, 0, 0
    least = -math.log(SIGNIFICANT)
    return best, sum(chance.surprise(x[0], len(s)) > least for x in found), start, end


def _design(best, many):
    return np.stack([np.ones(len(best)), np.log1p(best), np.log1p(many)], 1)


def fit_curve(best: np.ndarray, many: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge."""
    x, w = _design(best, many), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(texts: DataFrame, labels: DataFrame):
    """Learn from rows (id, text) whose id has a label (id, toxic): the tables, the background and the curve, or None."""
    spark = texts.sparkSession
    id_type = texts.schema["id"].dataType.simpleString()
    known = labels.where("toxic is not null and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    digests = texts.select("id", F.xxhash64("text").alias("digest")).join(known, "id")
    # equal texts are one, by the id of one of them; a merge join at every size, for the texts' side is never small
    chosen = digests.groupBy("digest").agg(F.min("id").alias("id"), F.avg("toxic").alias("toxic")).groupBy("id").agg(F.max((F.col("toxic") >= 0.5).cast("int")).alias("toxic"))
    packed = texts.mapInArrow(released(_packed), f"id {id_type}, blob binary")
    learned = stored(packed.join(chosen.hint("merge"), "id").select("id", "blob", "toxic"), "toxicity-labelled")

    sums = learned.select("blob", "toxic").mapInArrow(released(_count), "bucket long, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    found = sums.toArrow()  # 2 * BUCKETS rows at most
    n, t = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    at = found["bucket"].to_numpy()
    n[at], t[at] = found["n"].to_numpy(), found["t"].to_numpy()
    if not 0 < t.sum() < n.sum():
        return None
    base = float(t.sum() / n.sum())
    if n.max() < 1 << 31:  # each worker holds them
        n, t = n.astype(np.int32), t.astype(np.int32)
    sent = spark.sparkContext.broadcast((n, t, base))

    def histogram(batches):
        model, counts = Model(*sent.value), np.zeros(BINS, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                s = model.scores(text)
                counts += np.bincount(np.clip(np.floor(s / WIDTH).astype(np.int64) + BINS // 2, 0, BINS - 1), minlength=BINS)
        yield pa.record_batch([pa.array(np.arange(BINS)), pa.array(counts)], ["bin", "n"])

    bins = learned.where("toxic = 0").select("blob").mapInArrow(released(histogram), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BINS, np.int64)
    counts[bins["bin"].to_numpy()] = bins["n"].to_numpy()
    chance = Chance(counts)

    def points(batches):
        model = Model(*sent.value)
        for batch in batches:
            got = [summary(model, chance, text)[:2] for text in _texts(batch.column(0))]
            yield pa.record_batch([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), batch.column(1)], ["best", "many", "toxic"])

    # an even share of the ids, so that about FIT_ROWS rows are looked at
    share = int(1_000_000 * min(1.0, FIT_ROWS / max(1, learned.count())))
    sample = learned.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("blob", "toxic").mapInArrow(released(points), "best double, many long, toxic int").limit(2 * FIT_ROWS).toArrow()
    curve = fit_curve(*(sample[c].to_numpy().astype(float) for c in ("best", "many", "toxic")))
    return sent, chance, curve


def score(texts: DataFrame, model) -> DataFrame:
    """Rows (id, text) to id, score, n_segments, start and end (the best segment's words)."""
    schema = f"id {texts.schema['id'].dataType.simpleString()}, score double, n_segments long, start long, end long"
    names = ["id", "score", "n_segments", "start", "end"]
    if model is None:
        return texts.selectExpr("id", "0D as score", "0L as n_segments", "0L as start", "0L as end")
    sent, chance, curve = model

    def run(batches):
        words = Model(*sent.value)
        for batch in batches:
            got = [summary(words, chance, text) for text in batch.column(1).to_pylist()]
            best, many, start, end = (np.array([g[i] for g in got], float if not i else np.int64) for i in range(4))
            p = 1 / (1 + np.exp(-_design(best, many) @ curve))
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array(many), pa.array(start), pa.array(end)], names)

    return texts.mapInArrow(released(run), schema)


def without_toxic(docs: DataFrame, model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more."""
    if model is None:
        return docs
    sent, chance, curve = model
    at = docs.columns.index(text_col)

    def run(batches):
        words = Model(*sent.value)
        for batch in batches:
            got = [summary(words, chance, text) for text in batch.column(at).to_pylist()]
            p = 1 / (1 + np.exp(-_design(np.array([g[0] for g in got], float), np.array([g[1] for g in got], np.int64)) @ curve))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(released(run), docs.schema)


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    model = train(texts.where(fold("id", 4) != 2), labels)
    found = score(texts, model)
    return found.select(
        F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_segments", "start", "end"
    )
