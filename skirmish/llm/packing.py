"""Order-preserving packing by dynamic programming.

The texts of a partition, each followed by an end id, form one stream of token ids in the order of the rows. It is
cut into windows of at most 2048 ids. A window may end at a document's end for nothing, at a sentence's end for a
small penalty, and inside a sentence (a stretch of more than 64 ids without an end) for a larger one; the sum of
padding and penalties is least:

    cost(j) = penalty(j) + 2048 - t(j) + min over i, t(j) - t(i) <= 2048, of cost(i) + t(i)

The minimum over the window is kept in a monotone queue, so the whole is linear. Places are fed in blocks that end with a
document, and windows that every way to go on shares are given out, so a task holds one block, one text and the few
windows not yet settled, and the sum is the least of the whole stream whatever the blocks. Of equal sums the one with the
later cuts before is taken. No row moves between partitions: each input split is packed by itself, and only its last window is left part-filled.

Edge cases: a null text is empty and gives its end id alone; repeated rows and ids are packed each for itself; long
texts are cut into as many pieces as they need; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, released

WINDOW, END = 2048, 1
#: Penalties, in ids of padding, of a cut at a sentence's end and inside a sentence; the longest stretch without a place to cut.
SENTENCE, HARD, STRETCH = 6.0, 24.0, 64
#: Ids that are fed at once; results don't depend on it.
BLOCK = 1 << 18
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of a text as the tokenizer file gives them; its rank file, read by a quicker library, gives the same ones."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        self._json = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._exact = None
        stop = re.compile(rb"[.!?][\"')\]]*\s*$|\n")
        self.stops = np.zeros(max(ranks.values()) + 2, bool)
        for token, i in ranks.items():
            self.stops[i] = bool(stop.search(token))

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:  # the tokenizer file takes this string for one id
            if self._exact is None:
                from tokenizers import Tokenizer

                self._exact = Tokenizer.from_file(self._json)
            return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._quick.encode_ordinary(text), np.uint32)


class Cutter:
    """Chooses among places that come in ascending order (gaps of at most `window`); 0 is the start.

    Only what some live end of the queue can still lead back to is held.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.at, self.cost, self.back = [0], [0.0], [-1]
        self.queue: deque[tuple[float, int]] = deque([(0.0, 0)])

    def feed(self, places: list[int], penalties: list[float]) -> None:
        at, cost, back, queue, window = self.at, self.cost, self.back, self.queue, self.window
        for j, (t, penalty) in enumerate(zip(places, penalties, strict=True), len(at)):
            while at[queue[0][1]] < t - window:
                queue.popleft()
            value, i = queue[0]
            c = penalty + window - t + value
            at.append(t)
            cost.append(c)
            back.append(i)
            value = c + t
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, j))

    def _path(self, j: int) -> list[int]:
        out = []
        while j > 0:
            out.append(self.at[j])
            j = self.back[j]
        return out[::-1]

    def settled(self) -> list[int]:
        """Cuts that all ways to go on share, and lets go of what is before the last of them."""
        live = {i for _, i in self.queue}
        while len(live) > 1:
            j = max(live)
            live.remove(j)
            live.add(self.back[j])
        (j,) = live
        out = self._path(j)
        self.at, self.cost, self.back = self.at[j:], self.cost[j:], [-1, *(b - j for b in self.back[j + 1 :])]
        self.queue = deque((v, i - j) for v, i in self.queue)
        return out

    def rest(self) -> list[int]:
        """The cuts that are left when the last place is the end."""
        return self._path(len(self.at) - 1)


def cuts(places: list[int], penalties: list[float], window: int = WINDOW) -> list[int]:
    """The chosen ones of `places`, the last of which is the end."""
    cutter = Cutter(window)
    cutter.feed(places, penalties)
    return cutter.rest()


def candidates(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream may be cut, with their penalties. `ends`: places after each document's last id."""
    at = np.union1d(np.flatnonzero(stops[ids]) + 1, ends)
    gaps = np.diff(np.concatenate(([0], at)))
    extra = [np.arange(a - g + stretch, a, stretch) for a, g in zip(at[gaps > stretch].tolist(), gaps[gaps > stretch].tolist(), strict=True)]
    penalty = np.full(len(at), SENTENCE)
    penalty[np.searchsorted(at, ends)] = 0.0
    if extra:
        more = np.concatenate(extra)
        at, penalty = np.concatenate((at, more)), np.concatenate((penalty, np.full(len(more), HARD)))
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    return at, penalty


class Packer:
    """Takes documents one by one and gives out pieces (document, start, ids, its tokens, sequence, offset)."""

    def __init__(self, stops: np.ndarray, window: int = WINDOW, block: int = BLOCK):
        self.stops, self.window, self.block = stops, window, block
        self.cutter = Cutter(window)
        #: documents not yet given out: document, place of its first id in the stream, ids, how many of them are out
        self.parts: deque[list] = deque()
        self.fresh: list[np.ndarray] = []
        self.held, self.place, self.begin, self.sequence = 0, 0, 0, 0

    def add(self, doc, ids: np.ndarray):
        self.parts.append([doc, self.place + self.held, ids])
        self.fresh.append(ids)
        self.held += len(ids)
        return self.solve(False) if self.held >= self.block else []

    def solve(self, last: bool) -> list[tuple]:
        if self.fresh:
            at, penalty = candidates(np.concatenate(self.fresh), np.cumsum([len(x) for x in self.fresh]), self.stops, min(STRETCH, self.window))
            self.cutter.feed((at + self.place).tolist(), penalty.tolist())
            self.place, self.held, self.fresh = self.place + self.held, 0, []
        out = []
        for stop in self.cutter.rest() if last else self.cutter.settled():
            offset = 0
            while self.begin < stop:
                doc, first, ids = self.parts[0]
                lo, hi = self.begin - first, min(stop - first, len(ids))
                out.append((doc, lo, ids[lo:hi], len(ids), self.sequence, offset))
                offset += hi - lo
                self.begin += hi - lo
                if hi == len(ids):
                    self.parts.popleft()
            self.sequence += 1
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True, encoder: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Pieces of the packed texts: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids where asked.

    sequence_id holds the partition in its upper half, so it is unique without any exchange.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        encode, base = Encoder(*encoder), TaskContext.get().partitionId() << 32
        packer = Packer(encode.stops, window)
        id_type = None

        def batch_of(rows):
            columns = [
                pa.array([r[0] for r in rows], id_type), *(pa.array(x, pa.int64()) for x in (
                    [r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows],
                    [r[3] for r in rows], [base + r[4] for r in rows], [r[5] for r in rows]))]
            if with_ids:
                columns.append(pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32())))
            return pa.record_batch(columns, names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := packer.add(doc, np.append(encode(text or ""), np.uint32(END))):
                    yield batch_of(rows)
        if rows := packer.solve(True):
            yield batch_of(rows)

    return texts.mapInArrow(released(run), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), with_ids=False).withColumnRenamed("id", "doc_id")
