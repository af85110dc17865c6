"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits (insertions, deletions, substitutions of characters). Cut
into k + 1 pieces, it must have one piece unharmed, so exact hits of pieces, found in one Aho-Corasick pass, name
every place where an occurrence can be. A counting bound on short grams turns most chance hits away, and Myers'
bit-parallel distance decides the rest, so that exactly the occurrences within the budget are reported.

Texts are compared in lower case with white space squeezed, and places refer to that form.

Edge cases: null or empty texts hold nothing, null or empty items occur nowhere; an item too short for a budget has
budget 0 and is sought as it stands; rows and items may repeat, each gets its own results; empty tables give an
empty result; a text of any length is read whole; of equally good places the first counts; ids may be of any type, other
columns are not read (`contaminated`) or stay as they are (`without_leaks`).
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read_table, released

#: Share of an item's characters that may be edited, and characters that a piece has at least.
EDIT_SHARE, LEAST_PIECE = 0.1, 10
#: Bytes of items that one automaton takes; more items go in several passes over the documents.
BLOCK_BYTES = 4 << 20
GRAM = 4


def squeezed(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, share: float = EDIT_SHARE) -> int:
    return max(0, min(int(len(item) * share), len(item) // LEAST_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(k + 1)]


def best_end(pattern: str, peq: dict[str, int], text: str) -> tuple[int, int]:
    """Least distance of the pattern to any part of the text, and the first end of such a part (Myers 1999)."""
    m = len(pattern)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, at = m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return dict(out)


class Matcher:
    """Occurrences of the items in a text, for a block of items."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for ident, raw in items:
            if not (text := squeezed(raw)):
                continue
            k = budget(text, share)
            for at, piece in pieces(text, k):
                found[piece].append((len(self.items), at))
            self.items.append((ident, text, k, _masks(text), _masks(text[::-1]), {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()

    def __call__(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item that is within its budget."""
        text = squeezed(raw)
        if not text or not self.items:
            return []
        places: dict[int, set[int]] = defaultdict(set)
        for end, (length, owners) in self.automaton.iter(text):
            for which, at in owners:
                places[which].add(end - length + 1 - at)
        out = []
        for which, starts in places.items():
            ident, item, k, fore, back, grams = self.items[which]
            best, last = None, None
            for lo, hi in _merged(starts, k, len(item)):
                lo, hi = max(0, lo), min(len(text), hi)
                window = text[lo:hi]
                # each edit harms GRAM grams of the item at most
                if len(grams) > k * GRAM:
                    missing = sum(g not in window for g in grams)
                    if missing > k * GRAM:
                        continue
                dist, end = best_end(item, fore, window)
                if dist <= k and (best is None or dist < best[0]):
                    _, size = best_end(item[::-1], back, window[:end][::-1][: len(item) + k])
                    best = (dist, lo + end - size, lo + end)
            if best:
                out.append((ident, *best))
        return out


def _merged(starts: set[int], k: int, length: int) -> list[tuple[int, int]]:
    """Windows that hold all occurrences whose start is within k of one of `starts`; windows that nearly coincide are one."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        lo, hi = s - k, s + length + k
        if out and lo <= out[-1][0] + k:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _blocks(items: DataFrame, most: int):
    """The items in blocks of bounded bytes, one block at a time on the driver."""
    block, held = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        held += len((row[1] or "").encode("utf-8", "surrogatepass")) + 16
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs of a document and an item that occurs in it: id, item_id, distance, budget, start, end (of the squeezed text).

    The items are broadcast in blocks of `block_bytes`, so that no broadcast grows with the benchmark; a larger
    benchmark takes more passes over the documents.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = texts.schema["id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item_id {kinds[1]}, distance int, start long, end long"
    out = spark.createDataFrame([], schema)
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    for block in _blocks(items.select(item_col, item_text), block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            match = Matcher(sent.value, share)
            for batch in batches:
                ids, rows = batch.column(0), []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    rows += [(i, *x) for x in match(text)]
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch([
                    ids.take(take), pa.array([r[1] for r in rows], item_arrow), pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64()),
                ], ["id", "item_id", "distance", "start", "end"])

        out = out.union(texts.mapInArrow(released(run), schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without the rows in whose text an item occurs within its budget."""
    at = docs.columns.index(text_col)
    schema = docs.schema
    for block in _blocks(items.select(item_col, item_text), block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            match = Matcher(sent.value, share)
            for batch in batches:
                yield batch.filter(pa.array([not match(text) for text in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(released(run), schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "distance", "start", "end")
