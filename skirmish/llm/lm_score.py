"""LM scoring by logistic context mixing.

A text is its words (A-Z lower-cased) and one end. A word is coded byte by byte, with a space to end it, and each byte
bit by bit. Predictors look at the bits seen before under three contexts: the last two and three bytes, and the whole
word so far. All occurrences of all training words count; contexts are told apart by 56
bits of hash, and their counts lie in as many shards as there are buckets of words, so that they grow with the corpus. Their logits are summed under weights that a
gate picks by how much the longest contexts have seen; weights are learned online from all words, one
small batch of words after another, each with its count, and an occurrence being taken out first. Each bucket of words learns
by itself, and weights are averaged by what they have seen. A last table refines the mixed probability by what came of
it before.

A second mix codes the running text word by word. Its inputs are that spelling, the word's share of the training words,
its share after the word before, and the same two shares in the text so far. A gate (how often training has seen the
word before, how far the text is, whether the text has had the word before) picks their shares; they are what each input
explains of all training words and go on moving while a text is scored. It mixes probabilities of
words, not logits of bits. A training text is taken out of the counts of words and pairs before it is scored. The sum
is given in bits per byte too.

The corpus moves as chunks. A chunk asks for its distinct words and pairs of words in buckets by hash; a bucket sums
their training counts over all chunks, its words are scored once, and answers go back in the order of the questions. So
no vocabulary is ever broadcast or held whole, and only weights and shares reach the driver. A bucket asks the shards
for the counts of its words' contexts in the same way. Pairs are told apart by
their bucket and 40 bits of hash.

Edge cases: a null or empty text is one end; without training texts every count is 0; rows repeat as they are; a text
of any length is scored whole (a chunk is closed after the text that fills it); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import dropped, mix64, read_table, release, released, stored, words_of
from .toxicity import fold

#: Characters after which a chunk is closed; bytes of text for which there is a bucket.
CHUNK, BUCKET = 7 << 19, 16 << 20
#: Rows that the Parquet reader takes at a time: a chunk's row has megabytes.
READ_ROWS = 16
#: Base-2 logarithms of the sizes of the three tables of a mixer that holds its counts itself.
SIZES = (18, 19, 22)
STARTS = tuple(sum(1 << s for s in SIZES[:k]) for k in range(len(SIZES)))
SLOTS = sum(1 << s for s in SIZES)
#: Bytes of words between two moves of the mixer's weights.
LESSON = 2048
#: Steps of the gate's two counts, and of the refining table.
STEPS, CELLS, REACH = np.array([1, 3, 8, 32, 256, 4096]), 33, 8.0
#: Inputs of the mix of words; steps of its gate: occurrences of the word before in training, place in the text.
INPUTS, SEEN, PLACES = 5, np.array([1, 4, 16, 64, 512, 4096]), np.array([1, 8, 32, 128, 1024])
GATES = (len(SEEN) + 1) * (len(PLACES) + 1) * 2
#: Words between two moves of the shares while a text is scored; words that the learned shares count as then.
STRIDE, FIRM = 128, 24.0
#: Texts that are scored together.
TOGETHER = 4096

_POWER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_POWER, -1, 2**64)
_SHIFTS = np.arange(8, dtype=np.uint8)


class Bits:
    """The bits of some words: their values, and the slot that each context gives each bit."""

    def __init__(self, words: list[bytes]):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        ends = np.cumsum(sizes)
        start = np.repeat(ends - sizes, sizes)
        place = np.arange(len(data)) - start
        wide = data.astype(np.uint64)
        with np.errstate(over="ignore"):
            powers = np.full(len(data) + 1, _POWER, np.uint64)
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            back = np.full(len(data) + 1, _INVERSE, np.uint64)
            back[0] = 1
            back = np.multiply.accumulate(back)
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * powers[:-1], dtype=np.uint64)))
            prefix = (run[:-1] - run[start]) * back[start]
        last = []
        for k in range(1, 4):
            shifted = np.zeros(len(data), np.uint64)
            shifted[k:] = wide[:-k] if k < len(data) else 0
            last.append(np.where(place >= k, shifted + np.uint64(1), np.uint64(0)))
        two = last[0] | last[1] << np.uint64(9)
        contexts = two, two | last[2] << np.uint64(18), prefix + place.astype(np.uint64)
        self.data, self.contexts = data, contexts
        self.y = ((data[:, None] >> (7 - _SHIFTS)[None, :]) & 1).astype(bool).ravel()
        #: where each word's bits begin
        self.first = (ends - sizes) * 8
        self.sizes = sizes

    @property
    def slots(self) -> list[np.ndarray]:
        node = ((1 << _SHIFTS.astype(np.int64))[None, :] | (self.data[:, None] >> (8 - _SHIFTS)[None, :].astype(np.int64))).astype(np.uint64)
        out = []
        for k, context in enumerate(self.contexts):
            slot = mix64(mix64(context + np.uint64(k << 56))[:, None] + node) >> np.uint64(64 - SIZES[k])
            out.append(slot.astype(np.int64).ravel() + STARTS[k])
        return out

    def keys(self) -> np.ndarray:
        """Of each context and byte 56 bits of the context's hash, and the byte."""
        with np.errstate(over="ignore"):
            return np.stack([mix64(context + np.uint64((k + 1) << 56)) & ~np.uint64(255) | self.data for k, context in enumerate(self.contexts)])


def blocks(words: list[bytes], most: int = 1 << 16):
    """(start, end) of runs of words of about `most` bytes."""
    start, held = 0, 0
    for i, w in enumerate(words):
        held += len(w) + 1
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(words):
        yield start, len(words)


def stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4))


class Mixer:
    """Tables of counts, weights by gate, and the refining table."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray):
        self.n0, self.n1 = n0, n1
        self.weights = np.full(((len(STEPS) + 1) ** 2, len(SIZES)), 0.25)
        grid = (np.arange(CELLS) - CELLS // 2) * (2 * REACH / (CELLS - 1))
        self.refined = np.tile(1 / (1 + np.exp(-grid)), (len(self.weights), 1))
        #: bits that weights and cells of the refining table have learned from
        self.mass, self.cells = np.zeros(len(self.weights)), np.zeros_like(self.refined)

    def freeze(self):
        """The end of learning."""
        return self

    def _counts(self, bits: Bits, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Under each context the zeros and ones seen before each bit; `at`: bytes of words before these."""
        return [(self.n0[s], self.n1[s]) for s in bits.slots]

    def _cell(self, logit):
        at = (np.clip(logit, -REACH, REACH - 1e-6) + REACH) * ((CELLS - 1) / (2 * REACH))
        low = at.astype(np.int64)
        return low, at - low

    def _p(self, x, gate):
        logit = (x * self.weights[gate]).sum(1)
        low, part = self._cell(logit)
        mixed = 1 / (1 + np.exp(-np.clip(logit, -15, 15)))
        fine = self.refined[gate, low] * (1 - part) + self.refined[gate, low + 1] * part
        return mixed, np.clip((mixed + fine) / 2, 1e-6, 1 - 1e-6), low, part

    def learn(self, words: list[bytes], rate: float = 0.03, batch: int = 384, counts: np.ndarray | None = None):
        """Online: each batch of words, each as often as it counts, is predicted with the weights so far, then they (by Adagrad) and the refining table move."""
        spread = np.full_like(self.weights, 1e-6)
        gates, at = len(self.weights), 0
        for a, b in blocks(words, batch):
            bits = Bits(words[a:b])
            y = bits.y.astype(np.float32)
            many = np.ones(len(y)) if counts is None else np.repeat(counts[a:b], bits.sizes * 8).astype(np.float64)
            x, seen = [], []
            for n0, n1 in self._counts(bits, at):  # without the occurrence's own count
                n0, n1 = np.maximum(n0 - (1 - y), 0), np.maximum(n1 - y, 0)
                x.append(stretch(n0, n1))
                seen.append(n0 + n1)
            x = np.stack(x, 1)
            gate = np.searchsorted(STEPS, seen[-1], "right") * (len(STEPS) + 1) + np.searchsorted(STEPS, seen[-2], "right")
            mixed, _, low, part = self._p(x, gate)
            mass, off = np.bincount(gate, many, gates), many * (y - mixed)
            move = np.stack([np.bincount(gate, off * x[:, k], gates) for k in range(x.shape[1])], 1) / np.maximum(mass, 1)[:, None]
            self.mass += mass
            spread += move**2
            self.weights += rate * move / np.sqrt(spread)
            for cell, share in ((low, 1 - part), (low + 1, part)):
                flat = gate * CELLS + cell
                up = np.bincount(flat, share * many * y, gates * CELLS).reshape(-1, CELLS)
                all_ = np.bincount(flat, share * many, gates * CELLS).reshape(-1, CELLS)
                self.cells += all_
                self.refined += (up - all_ * self.refined) / (all_ + 50)
            at += len(bits.data)
        return self

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability."""
        out, at = np.empty(len(words)), 0
        for a, b in blocks(words):
            bits = Bits(words[a:b])
            seen = self._counts(bits, at)
            gate = np.searchsorted(STEPS, seen[-1][0] + seen[-1][1], "right") * (len(STEPS) + 1) + np.searchsorted(STEPS, seen[-2][0] + seen[-2][1], "right")
            p = self._p(np.stack([stretch(*n) for n in seen], 1), gate)[1]
            out[a:b] = np.add.reduceat(np.log10(np.where(bits.y, p, 1 - p)), bits.first)
            at += len(bits.data)
        return out


class Asked:
    """The distinct contexts and bytes of some words in the order of their shards and keys, and which of them each byte has."""

    def __init__(self, words: list[bytes], shards: int):
        keys, done = np.empty((len(SIZES), sum(map(len, words)) + len(words)), np.uint64), 0
        for a, b in blocks(words):
            part = Bits(words[a:b]).keys()
            keys[:, done : done + part.shape[1]] = part
            done += part.shape[1]
        found, at = [], []
        for row in keys:  # each context's keys are sorted alone, so that less is held at a time
            one, which = np.unique(row, return_inverse=True)
            at.append(which.astype(np.int32) + np.int32(sum(map(len, found))))
            found.append(one)
            del which
        del keys
        found = np.concatenate(found)
        shard = ((found >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((found, shard))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.which, self.keys = np.stack([rank[x] for x in at]), found[order]
        self.shards, self.starts = np.unique(shard[order], return_index=True)
        self.ends = np.append(self.starts, len(order))[1:]


class Sharded(Mixer):
    """A mixer of some words whose counts came from the shards: paths[d] counts the bytes that share a byte's first d bits, under each asked context."""

    def __init__(self, which: np.ndarray, paths: np.ndarray):
        super().__init__(np.zeros(0), np.zeros(0))
        self._which, self._paths = which, paths

    def _counts(self, bits: Bits, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for which in self._which[:, at : at + len(bits.data)]:
            path = self._paths[which]
            same = path[:, 1:].ravel()
            other = path[:, :-1].ravel() - same
            out.append((np.where(bits.y, other, same), np.where(bits.y, same, other)))
        return out


@cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(raw: bytes) -> bytes:
    return _zstd()[0].compress(raw)


def _unpack(blob: bytes) -> bytes:
    return _zstd()[1].decompress(blob)


def _words(blob: bytes) -> list[bytes]:
    return _unpack(blob).split(b" ")


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0, byte planes apart, as many as the largest needs, compressed."""
    values = values.astype("<i8")
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return _pack(bytes([wide]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())


def _whole(blob: bytes) -> np.ndarray:
    raw = _unpack(blob)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<i8").ravel()


class Pairs:
    """The distinct pairs (word before, word) of a chunk in the order of their buckets and keys, and which of them each word ends."""

    def __init__(self, codes: np.ndarray, hashes: np.ndarray, buckets: int):
        before = np.concatenate((np.zeros(1, np.int64), codes[:-1]))  # 0 is the end of a text
        with np.errstate(over="ignore"):
            h = mix64(mix64(hashes)[before] + hashes[codes])
        key = np.uint64((1 << 40) - 1)
        found, self.which = np.unique(((h >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | h & key, return_inverse=True)
        self.before, self.keys, bucket = before, (found & key).astype(np.int64), (found >> np.uint64(40)).astype(np.int64)
        self.buckets, self.starts = np.unique(bucket, return_index=True)
        self.ends = np.append(self.starts[1:], len(found))


def numbered() -> dict[bytes, int]:
    """Words get numbers when they are first looked up; the end of a text is 0."""
    out: defaultdict[bytes, int] = defaultdict()
    out.default_factory = out.__len__
    out[b""] = 0
    return out


_ASKS = "array<struct<bucket: long, words: binary, at: binary, counts: binary, texts: binary>>"
_CHUNKED = f"chunk long, codes binary, hashes binary, lengths array<long>, sizes array<long>, train array<boolean>, asks {_ASKS}, pairs array<struct<bucket: long, keys: binary, counts: binary>>"


def _chunks(buckets: int, id_type):
    """(id, train, text) to one row for each chunk, with its questions by bucket."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        names = ["chunk", "ids", "codes", "hashes", "lengths", "sizes", "train", "asks", "pairs"]
        ask = pa.list_(pa.struct([("bucket", pa.int64()), ("words", pa.binary()), ("at", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())]))
        ask_pairs = pa.list_(pa.struct([("bucket", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))
        number = TaskContext.get().partitionId() << 32
        ids, codes, lengths, sizes, flags, place, held = [], [], [], [], [], numbered(), 0

        def closed():
            words, code = list(place), np.concatenate(codes)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            taught = np.repeat(np.array(flags, bool), lengths)
            counts = np.bincount(code[taught], minlength=len(words))
            text = np.repeat(np.arange(len(lengths)), lengths)[taught]
            once = np.sort(text * len(words) + code[taught])
            texts = np.minimum(np.bincount(once[np.diff(once, prepend=-1) > 0] % len(words), minlength=len(words)), 2)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            asks = []
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                asks.append({"bucket": int(bucket[at[0]]), "words": _pack(b" ".join([words[i] for i in at])), "at": _planes(at), "counts": _planes(counts[at]), "texts": _planes(texts[at])})
            found = Pairs(code, hashes, buckets)
            many = np.bincount(found.which[taught], minlength=len(found.keys))
            pairs = [{"bucket": int(k), "keys": _planes(np.diff(found.keys[a:b], prepend=0)), "counts": _planes(many[a:b])} for k, a, b in zip(found.buckets, found.starts, found.ends, strict=True)]
            return pa.record_batch([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([_planes(code)], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())), pa.array([asks], ask), pa.array([pairs], ask_pairs),
            ], names)

        for batch in batches:
            for i, train, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                words.append(b"")
                ids.append(i)
                codes.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
                lengths.append(len(words))
                sizes.append(len((text or "").encode("utf-8", "surrogatepass")))
                flags.append(bool(train))
                held += sizes[-1]
                if held >= CHUNK:
                    yield closed()
                    number += 1
                    ids, codes, lengths, sizes, flags, place, held = [], [], [], [], [], numbered(), 0
        if ids:
            yield closed()

    return run


def _summed(table: pa.Table) -> pa.Table:
    """All questions of one bucket to its words and their training counts, the `single` first ones of no more than one training text."""
    total: Counter = Counter()
    held: Counter = Counter()
    for words, counts, texts in zip(*(table[c].to_pylist() for c in ("words", "counts", "texts")), strict=True):
        for w, n, t in zip(_words(words), _whole(counts).tolist(), _whole(texts).tolist(), strict=True):
            total[w] += n
            held[w] += t
    words = sorted(total, key=lambda w: (held[w] > 1, w))
    n, single = np.array([total[w] for w in words], np.int64), sum(held[w] < 2 for w in words)
    del total, held
    release()
    return pa.table({
        "bucket": pa.array([table["bucket"][0].as_py()], pa.int64()), "words": pa.array([_pack(b" ".join(words))], pa.binary()),
        "counts": pa.array([_pack(n.tobytes())], pa.binary()), "single": pa.array([single], pa.int64()),
        "tokens": pa.array([int(n.sum())], pa.int64()), "known": pa.array([int((n > 0).sum())], pa.int64()),
    })


def _asking(shards: int):
    """Buckets of words and counts to what they tell the shards, contexts and bytes with their training occurrences, and those they ask for."""

    def run(batches):
        for batch in batches:
            for bucket, words, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, n = _words(words), np.frombuffer(_unpack(counts), np.int64)
                told = Asked(words, shards)
                many = np.repeat(n, np.fromiter(map(len, words), np.int64, len(words)) + 1)
                sums = sum(np.bincount(which, many, len(told.keys)) for which in told.which).astype(np.int64)
                for shard, a, b in zip(told.shards.tolist(), told.starts, told.ends, strict=True):
                    keys = _pack(told.keys[a:b].tobytes())  # every word is spelled, so each context told is asked for too
                    blobs = keys, _planes(sums[a:b]), keys
                    yield pa.record_batch([pa.array([bucket], pa.int64()), pa.array([shard], pa.int64()), *(pa.array([x], pa.binary()) for x in blobs)], ["bucket", "shard", "keys", "counts", "wanted"])

    return run


def paths_of(keys: np.ndarray, table: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of each key how often its context had a byte with the same first 0 to 8 bits; `table`: sorted keys with `sums`."""
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(sums)))
    out = np.empty((len(keys), 9), np.int64)
    for d in range(9):
        rest = np.uint64((1 << (8 - d)) - 1)
        out[:, d] = before[np.searchsorted(table, keys | rest, "right")] - before[np.searchsorted(table, keys & ~rest, "left")]
    return out


def _sharded(table: pa.Table) -> pa.Table:
    """What one shard is told, to answers."""
    found, which = np.unique(np.concatenate([np.frombuffer(_unpack(k), np.uint64) for k in table["keys"].to_pylist()]), return_inverse=True)
    sums = np.bincount(which, np.concatenate([_whole(c) for c in table["counts"].to_pylist()])).astype(np.int64)
    del which
    blobs = []
    for wanted in table["wanted"].to_pylist():
        paths = paths_of(np.frombuffer(_unpack(wanted), np.uint64), found, sums)
        paths[:, :-1] -= paths[:, 1:].copy()
        blobs.append(_planes(paths.T.ravel()))
    del found, sums, paths
    release()
    return pa.table({"bucket": table["bucket"], "shard": table["shard"], "paths": pa.array(blobs, pa.binary())})


def _answered(words: list[bytes], shards: int, right: pa.Table) -> Sharded:
    """The mixer of a bucket's words, from the shards' answers."""
    asked = Asked(words, shards)
    parts = dict(zip(right["shard"].to_pylist(), right["paths"].to_pylist(), strict=True))
    paths = np.empty((len(asked.keys), 9), np.float32)
    for k, a, b in zip(asked.shards.tolist(), asked.starts, asked.ends, strict=True):  # shard by shard, so that one copy is held
        paths[a:b] = np.cumsum(_whole(parts[k]).reshape(9, -1)[::-1], 0)[::-1].T
    return Sharded(asked.which, paths)


def _learned(shards: int):
    """A bucket and its answers to what a mixer learns: of each weight and refined cell the value times the bits behind it, and the bits."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "sum": pa.array([], pa.float64()), "mass": pa.array([], pa.float64())})
        words, n = _words(left["words"][0].as_py()), np.frombuffer(_unpack(left["counts"][0].as_py()), np.int64)
        order = np.random.default_rng([17, left["bucket"][0].as_py()]).permutation(len(words))
        words, n = [words[i] for i in order], n[order]
        mixer = _answered(words, shards, right).learn(words, batch=LESSON, counts=n)
        mass = np.concatenate((np.repeat(mixer.mass, mixer.weights.shape[1]), mixer.cells.ravel()))
        value = np.concatenate((mixer.weights.ravel(), mixer.refined.ravel()))
        del mixer
        release()
        return pa.table({"cell": pa.array(np.arange(len(mass))), "sum": pa.array(value * mass), "mass": pa.array(mass)})

    return run


def _logs(shards: int, weights: np.ndarray, refined: np.ndarray):
    """A bucket and its answers to its words with counts, and the log10 probabilities that spelling gives them, each of them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = []
        for words in left["words"].to_pylist():
            words = _words(words)
            mixer = _answered(words, shards, right)
            mixer.weights, mixer.refined = weights, refined
            got.append(_pack(mixer.log10(words).tobytes()))
            del mixer, words
        release()
        return left.append_column("logs", pa.array(got, pa.binary()))

    return run


def train_mixer(vocabulary: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Weights and the refining table over all training words, and the shards' answers to each bucket."""
    asked = vocabulary.select("bucket", "words", "counts").mapInArrow(released(_asking(shards)), "bucket long, shard long, keys binary, counts binary, wanted binary")
    paths = stored(asked.groupBy("shard").applyInArrow(_sharded, "bucket long, shard long, paths binary"), "lm-paths")
    both = vocabulary.select("bucket", "words", "counts", "single").groupBy("bucket").cogroup(paths.groupBy("bucket"))
    learned = both.applyInArrow(_learned(shards), "cell long, sum double, mass double").groupBy("cell").agg(F.sum("sum").alias("sum"), F.sum("mass").alias("mass"))
    mixer = Mixer(np.zeros(0), np.zeros(0))
    for row in stored(learned.where("mass > 0"), "lm-weights").toLocalIterator():  # one row a weight or cell
        held, at = (mixer.weights, row.cell) if row.cell < mixer.weights.size else (mixer.refined, row.cell - mixer.weights.size)
        held[divmod(at, held.shape[1])] = row["sum"] / row.mass
    return mixer.weights, mixer.refined, paths


def _answers(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bucket's questions, and its words with counts and log10 probabilities, to answers in the questions' order."""
    known: dict[bytes, int] = {}
    n, p = np.zeros(0, np.int64), np.zeros(0)
    if right.num_rows:
        known = {w: i for i, w in enumerate(_words(right["words"][0].as_py()))}
        n, p = np.frombuffer(_unpack(right["counts"][0].as_py()), np.int64), np.frombuffer(_unpack(right["logs"][0].as_py()), np.float64)
    counts, logs = [], []
    for words in left["words"].to_pylist():
        at = np.array([known[w] for w in _words(words)], np.int64)
        counts.append(_planes(n[at]))
        logs.append(p[at].astype(np.float32).tobytes())
    return pa.table({"chunk": left["chunk"], "bucket": left["bucket"], "counts": pa.array(counts, pa.binary()), "logs": pa.array(logs, pa.binary())})


def _paired(table: pa.Table) -> pa.Table:
    """All questions of one bucket of pairs to answers: the pairs' training counts over all chunks."""
    keys = [np.cumsum(_whole(k)) for k in table["keys"].to_pylist()]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate([_whole(c) for c in table["counts"].to_pylist()])).astype(np.int64)[which]
    parts = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
    # buckets of pairs count from -1 downwards
    return pa.table({"chunk": table["chunk"], "bucket": pa.array([-1 - k for k in table["bucket"].to_pylist()], pa.int64()), "counts": pa.array([_planes(p) for p in parts], pa.binary()), "logs": pa.array([b""] * len(parts), pa.binary())})


def _repeats(text: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place how often its id came before in its text, and how often it comes there in all."""
    keys, bits = text * (int(ids.max(initial=0)) + 1) + ids, len(ids).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits < 63:  # keys and places in one number: a plain sort is quicker
        ranked = np.sort(keys << bits | np.arange(len(keys)))
        order, ranked = ranked & ((1 << bits) - 1), ranked >> bits
    else:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(keys)])
    size = np.diff(np.append(first, len(keys)))
    before, total = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    before[order], total[order] = np.arange(len(keys)) - np.repeat(first, size), np.repeat(size, size)
    return before, total


def word_inputs(text: np.ndarray, ids: np.ndarray, pairs: np.ndarray, spelled: np.ndarray, count: np.ndarray, prior: np.ndarray, both: np.ndarray, tokens: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of some texts, one after another, the probabilities that the inputs give it, and the gate.

    `text`: number of each word's text; `count`, `prior`, `both`: training counts of the word, the word before, and the
    two together; `own`: its text is one of the training texts, and is taken out of the counts. An input without evidence
    stands back for a plainer one.
    """
    first = np.flatnonzero(np.diff(text, prepend=-1))
    size = np.diff(np.append(first, len(text)))
    place = np.arange(len(text)) - np.repeat(first, size)
    seen, all_ = _repeats(text, ids)
    seen_pair, all_pairs = _repeats(text, pairs)
    # the word before stood before as often as it had when it was the word itself; a text's first word follows an end
    seen_prior, all_prior = np.concatenate((seen[:1], seen[:-1])), np.concatenate((all_[:1], all_[:-1]))
    seen_prior[first], all_prior[first] = 0, 1
    left = tokens - np.repeat(size, size) * own
    count, prior, both = count - all_ * own, prior - all_prior * own, both - all_pairs * own
    frequent = np.where(left > 0, count / np.maximum(left, 1), spelled)
    after = np.where(prior > 0, both / np.maximum(prior, 1), frequent)
    again = np.where(place > 0, seen / np.maximum(place, 1), frequent)
    again_after = np.where(seen_prior > 0, seen_pair / np.maximum(seen_prior, 1), again)
    gate = (np.searchsorted(SEEN, prior, "right") * (len(PLACES) + 1) + np.searchsorted(PLACES, place, "right")) * 2 + (seen_prior > 0)
    return np.stack((spelled, frequent, after, again, again_after), 1), gate


def _taken(p: np.ndarray, gate: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' mixed probabilities, and by gate how much of the words each input explains."""
    parts = p * shares[gate]
    mixed = np.maximum(parts @ np.ones(INPUTS), 1e-300)
    parts /= mixed[:, None]
    return mixed, np.stack([np.bincount(gate, parts[:, k], GATES) for k in range(INPUTS)], 1)


def text_scores(p: np.ndarray, gate: np.ndarray, lengths: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """log10 probability of each of some texts, whose words stand one after another.

    A text's shares move after every STRIDE of its words; TOGETHER texts go forward together, the longest first.
    """
    if len(lengths) > TOGETHER:  # each text holds shares of its own
        starts, out = np.cumsum(lengths) - lengths, np.empty(len(lengths))
        for k in range(0, len(lengths), TOGETHER):
            part = slice(starts[k], starts[k] + lengths[k : k + TOGETHER].sum())
            out[k : k + TOGETHER] = text_scores(p[part], gate[part], lengths[k : k + TOGETHER], shares)
        return out
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    left = lengths[order].astype(np.int64)
    total, held = np.zeros(len(lengths)), np.tile(FIRM * shares, (len(lengths), 1))
    done = 0
    while len(left):
        size = np.minimum(left, STRIDE)
        text = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(text)) + np.repeat(first[: len(size)] + done - (np.cumsum(size) - size), size)
        cell = text * GATES + gate[at]
        held = held[: len(size) * GATES]
        norm = held.sum(1)
        parts = p[at] * held[cell]
        mixed = np.maximum(parts @ np.ones(INPUTS), 1e-300)
        total[: len(size)] += np.bincount(text, np.log10(mixed / norm[cell]), len(size))
        parts /= mixed[:, None]
        for k in range(INPUTS):
            held[:, k] += np.bincount(cell, parts[:, k], len(held))
        done += STRIDE
        left = left - STRIDE
        left = left[: np.searchsorted(-left, 0)]
    out = np.empty(len(lengths))
    out[order] = np.minimum(total, 0.0)
    return out


def _read(tokens: int, buckets: int):
    """A chunk and its answers to its row, codes, training counts, each word's text and whether that is a training text, and the words' inputs and gates."""

    def run(left: pa.Table, right: pa.Table):
        answers = {b: (c, p) for b, c, p in zip(*(right[k].to_pylist() for k in ("bucket", "counts", "logs")), strict=True)}
        for row in left.to_pylist():
            hashes, codes = np.frombuffer(row["hashes"], np.uint64), _whole(row["codes"])
            count, logs = np.zeros(len(hashes), np.int64), np.zeros(len(hashes))
            for ask in row["asks"]:
                at, (c, p) = _whole(ask["at"]), answers[ask["bucket"]]
                count[at], logs[at] = _whole(c), np.frombuffer(p, np.float32)
            pairs = Pairs(codes, hashes, buckets)
            both = np.concatenate([_whole(answers[-1 - k][0]) for k in pairs.buckets.tolist()])
            text = np.repeat(np.arange(len(row["lengths"])), row["lengths"])
            own = np.array(row["train"], bool)[text]
            prior = pairs.before  # a text begins after an end, whose number is 0
            yield row, codes, count, text, own, *word_inputs(text, codes, pairs.which, (10.0**logs)[codes], count[codes], count[prior], both[pairs.which], tokens, own)

    return run


def _explained(tokens: int, buckets: int):
    """Chunks and answers to how much each input explains, by gate, over the chunk's training texts."""
    read = _read(tokens, buckets)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros((GATES, INPUTS))
        for _, _, _, _, own, p, gate in read(left, right):
            if own.any():
                p, gate = (p, gate) if own.all() else (p[own], gate[own])
                out += _taken(p, gate, np.full((GATES, INPUTS), 1 / INPUTS))[1]
        return pa.table({"cell": pa.array(np.arange(out.size)), "sum": pa.array(out.ravel())})

    return run


def _scored(tokens: int, distinct: int, buckets: int, shares: np.ndarray, id_type):
    read = _read(tokens, buckets)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k in ("id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for row, codes, count, _, _, p, gate in read(left, right):
            base = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1)))[codes]
            ends = np.cumsum(row["lengths"])
            first = ends - row["lengths"]
            scores = text_scores(p, gate, np.array(row["lengths"]), shares)
            bases, known = np.add.reduceat(base, first), np.add.reduceat(count[codes] > 0, first, dtype=np.int64)
            for k, (i, size, train, a, b) in enumerate(zip(row["ids"], row["sizes"], row["train"], first.tolist(), ends.tolist(), strict=True)):
                values = i, train, b - a, int(known[k]), float(bases[k]), float(scores[k]), size
                for name, v in zip(out, values, strict=True):
                    out[name].append(v)
        kinds = id_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})

    return run


def score_texts(texts: DataFrame) -> DataFrame:
    """Rows (id, train, text) to id, train, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    kind = texts.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(texts.schema["id"].dataType)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, size // BUCKET)  # by the texts alone, so that scores don't depend on how the rows are split
    schema = _CHUNKED.replace("codes binary", f"ids array<{kind}>, codes binary")
    chunks = stored(texts.select("id", "train", "text").mapInArrow(released(_chunks(buckets, id_type)), schema), "lm-chunks")
    asks = chunks.select("chunk", F.explode("asks").alias("ask")).select("chunk", "ask.bucket", "ask.words", "ask.counts", "ask.texts")

    summed = asks.select("bucket", "words", "counts", "texts").groupBy("bucket").applyInArrow(_summed, "bucket long, words binary, counts binary, single long, tokens long, known long")
    vocabulary = stored(summed, "lm-words")
    total = vocabulary.agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known")).first()
    tokens, distinct = total.tokens or 0, total.known or 0
    weights, refined, paths = train_mixer(vocabulary, buckets)
    both = vocabulary.select("bucket", "words", "counts", "single").groupBy("bucket").cogroup(paths.groupBy("bucket"))
    known = stored(both.applyInArrow(_logs(buckets, weights, refined), "bucket long, words binary, counts binary, single long, logs binary"), "lm-logs")
    dropped(paths)
    dropped(vocabulary)
    answers = asks.select("chunk", "bucket", "words").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answers, "chunk long, bucket long, counts binary, logs binary")
    asked = chunks.select("chunk", F.explode("pairs").alias("ask")).select("chunk", "ask.bucket", "ask.keys", "ask.counts")
    answers = stored(answers.unionAll(asked.groupBy("bucket").applyInArrow(_paired, "chunk long, bucket long, counts binary, logs binary")), "lm-answers")
    dropped(known)
    plain = stored(chunks.drop("pairs").withColumn("asks", F.transform("asks", lambda a: F.struct(a["bucket"].alias("bucket"), a["at"].alias("at")))), "lm-plain")
    dropped(chunks)
    both = plain.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    found = np.ones((GATES, INPUTS))
    explained = stored(both.applyInArrow(_explained(tokens, buckets), "cell long, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")), "lm-shares")
    for row in explained.toLocalIterator():  # one row a cell
        found[divmod(row["cell"], INPUTS)] += row["sum"]
    shares = found / found.sum(1, keepdims=True)
    schema = f"id {kind}, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    out = both.applyInArrow(_scored(tokens, distinct, buckets, shares, id_type), schema)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = score_texts(docs.select(F.col("doc_id").alias("id"), (fold("doc_id", 10) != 0).alias("train"), "text"))
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
