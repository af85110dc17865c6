"""N-gram Jaccard join by parity sketches.

Every shingle of a text toggles one bit of a sketch, so the Hamming distance of two sketches never exceeds the
symmetric difference of their shingle sets. For two sets of a size band that difference is at most some d when
their Jaccard similarity reaches the threshold. The sketch is cut into d + 1 + E pieces: the sketches differ in at
most d of them, so they agree in E + 1 pieces at least, and in one that isn't empty unless a set has more than E
empty pieces (such a set puts its empty pieces into the index too). Sets that share a piece are candidates, and
candidates are verified on their whole shingle sets.

A class whose keys are shared by others less often than the bound asks for has no partner and goes first; of the
others the commonest keys go, as many as any partner must share beyond one; keys with the same classes are one bucket.

Groups stay small work: equal sets are one class before anything is joined. In a bucket the Hamming distance of
whole sketches turns most pairs away; of the others only enough to join what hangs together goes on to be verified.
Then, once the verified links' components are known, the rows that some row of another component may link with are
compared by whole sets inside their bucket, and only enough links come out to join the components. So no stage puts
out more than some rows for each row of a bucket, and no link between different components is missed. Buckets beyond a
bound are dealt out in pairs of blocks.

Edge cases: a null or empty text has an empty set and links with nothing; a text with fewer words than a shingle is
one shingle; rows with equal or null ids are each returned; an empty table gives an empty result; of equal texts the
smallest id names the component, null ids never do; columns other than id and text are not read. Classes are named
by a 64-bit digest of the set: at a billion different sets the chance of one false merge is about 3 %.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, dropped, fresh_name, groups_of, mix64, read_table, released, runs, shingle_sets, stored

#: Each size band's upper end is this much of its lower end.
BAND = 1.5
#: Bits of each piece of a sketch; classes of a bucket that one piece of work compares by sketch, and their shingles where whole sets are compared.
PIECE_BITS, BLOCK, BLOCK_SHINGLES = 4096, 4096, 2_000_000


class Bands:
    """Size bands, and for each the pieces that its sketches are cut into, for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.starts = num, den, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * BAND)))

    def of(self, size: int) -> list[int]:
        """Its own band, and the lower ones that hold sizes near enough."""
        k = bisect_right(self.starts, size) - 1
        out = [k]
        while k and self.num * size <= self.den * (self.starts[k] - 1):
            k -= 1
            out.append(k)
        return out

    def differences(self, band: int) -> int:
        """The most by which two sets can differ, the smaller one of this band, and still reach the similarity."""
        top = self.starts[band + 1] - 1
        return (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def spare(self, band: int) -> int:
        return 1 + self.differences(band) // 10


def piece_keys(shingles: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of the sets that stand one after another in `shingles`, and the set that each key is of."""
    mine = [bands.of(int(s)) if s else [] for s in sizes]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for r in range(max(map(len, mine), default=0)):
        band = np.array([m[r] if r < len(m) else -1 for m in mine], np.int64)
        differ = np.array([bands.differences(int(b)) if b >= 0 else 0 for b in band], np.int64)
        spare = np.array([bands.spare(int(b)) if b >= 0 else 0 for b in band], np.int64)
        use = differ > 0  # else only equal sets reach the similarity
        pieces = differ + 1 + spare
        take = use[owner]
        o = owner[take]
        if not len(o):
            continue
        h = mix64(shingles[take] + band[o].astype(np.uint64))
        piece = h % pieces[o].astype(np.uint64)
        place = (h >> np.uint64(40)) % np.uint64(PIECE_BITS)
        slot = (o.astype(np.uint64) << np.uint64(40)) | piece
        order = np.argsort(slot)
        slot = slot[order]
        bit = mix64(((piece << np.uint64(16)) + place)[order] + np.uint64(0x5851F42D4C957F2D))
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        # XOR of the toggled bits' codes: equal for equal pieces, 0 for an empty one
        digest = np.bitwise_xor.reduceat(bit, first)
        full = digest != 0
        slot, digest = slot[first][full], digest[full]
        o, piece = (slot >> np.uint64(40)).astype(np.int64), slot & np.uint64((1 << 40) - 1)
        code = band.astype(np.uint64) * np.uint64(2)
        keys.append(_marked(mix64(digest + (piece << np.uint64(20)) + code[o] + np.uint64(1)), band[o]))
        owners.append(o)
        empty = np.where(use, pieces - np.bincount(o, minlength=len(sizes)), 0)
        for i in np.flatnonzero(empty > spare):
            missing = np.setdiff1d(np.arange(pieces[i], dtype=np.uint64), piece[o == i])
            keys.append(_marked(mix64((missing << np.uint64(20)) + code[i]), np.full(len(missing), band[i])))
            owners.append(np.full(len(missing), i))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _marked(keys: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Keys that carry their band in the lowest seven bits."""
    return (keys & ~np.uint64(127)) | band.astype(np.uint64)


def _needed(num: int, den: int):
    """Keys of a band (column band) that a class of size n must share with any one partner, as a column.

    Sketches of a pair agree in all pieces but as many as the sets differ by, and a set that keeps its empty pieces back
    has no more of them than are spare. The partner that differs most is as large as the similarity lets it be.
    """
    top = F.array(*[F.lit(s - 1).cast("long") for s in Bands(num, den).starts[1:]])[F.col("band").cast("int")]
    off, both = den - num, den + num
    most = F.floor((top + F.floor(top * den / num)) * off / both)
    partner = F.when(F.col("n") <= top, F.floor(F.col("n") * den / num)).otherwise(top)
    return F.greatest(F.lit(1).cast("long"), most + 1 - F.floor((F.col("n") + partner) * off / both))


def _classes(shingles: np.ndarray, sizes: np.ndarray) -> list[int | None]:
    """Digest of each set, none of an empty one."""
    import xxhash

    ends = np.cumsum(sizes).tolist()
    return [xxhash.xxh3_64_intdigest(shingles[a:b].tobytes()) - 2**63 if b > a else None for a, b in zip([0, *ends], ends)]


def _sized(n: int):
    """Arrow batches (id, digest of the text, text) to id, digest, n_shingles and class."""

    def run(batches):
        words = WordHashes()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in groups_of(texts):
                shingles, sizes = shingle_sets(texts[a:b], n, words)
                classes = pa.array(_classes(shingles, sizes), pa.int64())
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), classes], ["id", "digest", "n_shingles", "cid"])

    return run


def _keyed(n: int, num: int, den: int):
    """Arrow batches (text) to index entries (key, class); copies in one task give theirs once."""

    def run(batches):
        words, bands, seen = WordHashes(), Bands(num, den), set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in groups_of(texts):
                shingles, sizes = shingle_sets(texts[a:b], n, words)
                classes = _classes(shingles, sizes)
                fresh = np.zeros(b - a, bool)
                if len(seen) > 200_000:
                    seen.clear()
                for i, c in enumerate(classes):
                    if c is not None and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                keys, owners = piece_keys(shingles[np.repeat(fresh, sizes)], np.where(fresh, sizes, 0), bands)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.array([c or 0 for c in classes], np.int64)[owners])], ["key", "cid"])

    return run


def _packed(batches):
    """(digest, text) to one row for each digest in the task, with the text compressed."""
    import zstandard

    seen, pack = set(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        digests, blobs = [], []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if d not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(d)
                digests.append(d)
                blobs.append(pack.compress((text or "").encode("utf-8", "surrogatepass")))
        yield pa.record_batch([pa.array(digests, pa.int64()), pa.array(blobs, pa.binary())], ["digest", "blob"])


def sketch(shingles: np.ndarray) -> bytes:
    """Parity sketch of a set, of two to four bits an element, as bytes of a power of two."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    places = (mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded by XOR to the shortest one's length."""
    least = min(map(len, sketches))
    out = np.empty((len(sketches), least // 8), np.uint64)
    for i, raw in enumerate(sketches):
        words = np.frombuffer(raw, np.uint64)
        out[i] = words if len(raw) == least else np.bitwise_xor.reduce(words.reshape(-1, least // 8), axis=0)
    return out


class _Close:
    """The rows of a bucket (cid, size, sketch, block) and which of them a row's sketch does not part from it."""

    def __init__(self, cid, size, sketches, block, across: bool, num: int, den: int):
        self.cid, self.size, self.block = np.array(cid), np.array(size), np.array(block)
        self.flat, self.across, self.num, self.den = folded(sketches), across, num, den

    def __call__(self, k: int, others: np.ndarray) -> np.ndarray:
        num, den, size = self.num, self.den, self.size
        if self.across:
            others = others[self.block[others] != self.block[k]]
        most = (size[others] + size[k]) * (den - num) // (den + num)
        fits = (num * size[others] <= den * size[k]) & (num * size[k] <= den * size[others])
        return others[fits & (np.bitwise_count(self.flat[others] ^ self.flat[k]).sum(1) <= most)]


def _near(num: int, den: int):
    """Rows (bucket, i, j, block, cid, size, sketch) sorted by bucket, i and j to enough pairs (a, b) to join all that sketches don't part."""

    def pairs(rows):
        close = _Close([r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows], [r[3] for r in rows], rows[0][1] != rows[0][2], num, den)
        every, group = np.arange(len(rows)), np.arange(len(rows))
        for k in every:
            if k and group[k] == group[0]:
                continue  # what the first row took in is met by the others
            hit = close(k, every[every != k])
            _, first = np.unique(group[hit], return_index=True)
            for h in hit[first]:
                if group[h] != group[k]:
                    yield close.cid[k], close.cid[h]
                    group[group == group[h]] = group[k]

    def run(batches):
        a, b = [], []
        for rows in runs(batches, 3):
            for x, y in pairs(rows) if len(rows) > 1 else ():
                a.append(min(x, y))
                b.append(max(x, y))
                if len(a) > 20_000:
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    a, b = [], []
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _alike(num: int, den: int):
    """Rows (bucket, i, j, block, cid, root, size, sketch) sorted by bucket, i and j to the rows (bucket, cid) that some row of another root is not parted from."""

    def run(batches):
        for rows in runs(batches, 3):
            if len(rows) < 2:
                continue
            close = _Close([r[4] for r in rows], [r[6] for r in rows], [r[7] for r in rows], [r[3] for r in rows], rows[0][1] != rows[0][2], num, den)
            root, every, found = np.array([r[5] for r in rows]), np.arange(len(rows)), np.zeros(len(rows), bool)
            kinds, of, many = np.unique(root, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(of != many.argmax()):  # of two rows of different roots one at least is outside the largest root
                hit = close(k, every[root != root[k]])
                found[hit] = True
                found[k] |= len(hit) > 0
            yield pa.record_batch([pa.array(np.full(found.sum(), rows[0][0])), pa.array(close.cid[found])], ["bucket", "cid"])

    return run


def _linked(n: int, num: int, den: int):
    """Rows (bucket, i, j, block, cid, root, size, blob) sorted by bucket, i and j to links (a, b), enough to join all roots that whole shingle sets link."""

    def links(rows, sets):
        close = _Close([r[4] for r in rows], [r[6] for r in rows], [sketch(s) for s in sets], [r[3] for r in rows], rows[0][1] != rows[0][2], num, den)
        group, every = np.unique([r[5] for r in rows], return_inverse=True)[1], np.arange(len(rows))
        for k in every:
            for h in close(k, every[k + 1 :][group[k + 1 :] != group[k]]):
                if group[h] != group[k]:
                    both = len(np.intersect1d(sets[k], sets[h], assume_unique=True))
                    if den * both >= num * (len(sets[k]) + len(sets[h]) - both):
                        yield int(close.cid[k]), int(close.cid[h])
                        group[group == group[h]] = group[k]

    def run(batches):
        import zstandard

        words, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for rows in runs(batches, 3):
            if len(rows) < 2:
                continue
            sets = [shingle_sets([unpack.decompress(r[7]).decode("utf-8", "surrogatepass")], n, words)[0] for r in rows]
            found = list(links(rows, sets))  # fewer than the rows
            yield pa.record_batch([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], ["a", "b"])

    return run


def _described(n: int):
    """(blob) to class, blob, size of the shingle set and its sketch."""

    def run(batches):
        import zstandard

        words, unpack = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [unpack.decompress(blob).decode("utf-8", "surrogatepass") for blob in batch.column(0).to_pylist()]
            for a, b in groups_of(texts):
                shingles, sizes = shingle_sets(texts[a:b], n, words)
                ends = np.concatenate(([0], np.cumsum(sizes)))
                sketches = [sketch(shingles[x:y]) for x, y in zip(ends, ends[1:])]
                yield pa.record_batch(
                    [pa.array(_classes(shingles, sizes), pa.int64()), batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["cid", "blob", "size", "sketch"]
                )

    return run


def _checked(n: int, num: int, den: int):
    """Pairs with both texts (a, b, blob_a, blob_b) to those whose shingle sets reach the similarity."""

    def run(batches):
        import zstandard

        words, unpack, known = WordHashes(), zstandard.ZstdDecompressor(), {}

        def shingles(cid, blob):
            if (s := known.get(cid)) is None:
                if len(known) > 256:
                    known.clear()
                known[cid] = s = shingle_sets([unpack.decompress(blob).decode("utf-8", "surrogatepass")], n, words)[0]
            return s

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, t = shingles(a, x), shingles(b, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of `pairs` (a, b) whose whole shingle sets reach the similarity. Compressed texts move: they are a quarter of the sets."""
    with_a = pairs.join(texts.select(F.col("cid").alias("a"), F.col("blob").alias("x")), "a")
    with_both = with_a.join(texts.select(F.col("cid").alias("b"), F.col("blob").alias("y")), "b")
    return with_both.select("a", "b", "x", "y").mapInArrow(released(_checked(n, num, den)), "a long, b long")


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with `bucket`, `cid` and `blocks` to (bucket, i, j, block, cid, columns), each pair of a bucket's blocks one sorted piece of work."""
    rows = rows.select("bucket", F.pmod(F.xxhash64("cid"), "blocks").alias("block"), "cid", *columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", *columns)
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")


def _buckets(entries: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Index entries (key, cid), repeated ones too, to the buckets (bucket, cid, blocks) in which partners meet.

    Of its K shared keys of a band a class needs `need` in common with any one partner. So classes with fewer go, and of
    the others the need - 1 keys that most classes share: the rarest key that two partners share is left with both.
    Keys with the same classes are one bucket.
    """
    by_key, by_band = Window.partitionBy("key"), Window.partitionBy("cid", "band")
    ends = F.min("cid").over(by_key).alias("lead"), F.max("cid").over(by_key).alias("last")
    mixed = entries.select("key", "cid", *ends).where("lead != last").dropDuplicates(["key", "cid"])
    mixed = mixed.select("key", "cid", F.count(F.lit(1)).over(by_key).alias("many"), F.col("key").bitwiseAND(127).alias("band"))
    mixed = mixed.join(classes.hint("merge").select("cid", "n"), "cid").withColumn("need", _needed(num, den))
    mixed = mixed.withColumn("shares", F.count(F.lit(1)).over(by_band)).where("shares >= need")
    mixed = mixed.withColumn("place", F.row_number().over(by_band.orderBy(F.desc("many"), "key"))).where("place >= need")
    shared = mixed.select("key", "cid", F.count(F.lit(1)).over(by_key).alias("many"), F.sum(F.shiftright(F.xxhash64("cid"), 20)).over(by_key).alias("a"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "cid"), 20)).over(by_key).alias("b"))
    shared = shared.where("many > 1").select(F.xxhash64("many", "a", "b").alias("bucket"), "cid", F.ceil(F.col("many") / BLOCK).cast("long").alias("blocks"))
    return shared.groupBy("bucket", "cid").agg(F.max("blocks").alias("blocks"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: id, n_shingles, class (cid) and component_id, the smallest id reachable over links of num / den or more."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    rows = stored(texts.mapInArrow(released(_sized(n)), f"id {id_type}, digest long, n_shingles long, cid long"), "parity-rows")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("digest").alias("digest"), F.first("n_shingles").alias("n"))
    shared = stored(_buckets(texts.select("text").mapInArrow(released(_keyed(n, num, den)), "key long, cid long"), classes, num, den), "parity-buckets")

    wanted = classes.join(shared.select("cid").distinct(), "cid", "left_semi")
    blobs = texts.select("digest", "text").mapInArrow(released(_packed), "digest long, blob binary").join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    held = stored(blobs.select("blob").mapInArrow(released(_described(n)), "cid long, blob binary, size long, sketch binary"), "parity-texts")

    work = _dealt(shared.join(held.select("cid", "size", "sketch"), "cid"), "size", "sketch")
    links = stored(_verified(work.mapInArrow(released(_near(num, den)), "a long, b long").distinct(), held, n, num, den), "parity-links")
    roots = connected_components(links)

    # What is left: links between different components. Only buckets that hold two components take part, and of them the rows that sketches don't part.
    by_bucket = Window.partitionBy("bucket")
    placed = shared.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = placed.select("*", F.min("root").over(by_bucket).alias("r0"), F.max("root").over(by_bucket).alias("r1")).where("r0 != r1").select("bucket", "cid", "root", "blocks")
    work = _dealt(mixed.join(held.select("cid", "size", "sketch"), "cid"), "root", "size", "sketch")
    alike = stored(work.mapInArrow(released(_alike(num, den)), "bucket long, cid long").distinct(), "parity-alike")
    alike = alike.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(held.select("cid", "size", "blob"), "cid")
    alike = alike.withColumn("blocks", F.ceil(F.sum("size").over(by_bucket) / BLOCK_SHINGLES).cast("long"))
    more = _dealt(alike, "root", "size", "blob").mapInArrow(released(_linked(n, num, den)), "a long, b long")
    links = stored(links.union(more), "parity-links")
    dropped(shared, held)
    roots = connected_components(links)

    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("id").alias("least"))
    classes = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("cid", "component_id")
    return rows.join(named, "cid", "left").select(F.col("id"), "n_shingles", "cid", F.coalesce("component_id", "id").alias("component_id"))


def deduplicated(docs: DataFrame, text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """`docs` with one row of each group of near copies; rows without words stay. `docs` is a stored table: its rows are numbered by place, twice."""
    row = fresh_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard_components(numbered, row, text_col, n, num, den)
    return numbered.join(found.where("id != component_id").select(F.col("id").alias(row)), row, "left_anti").drop(row)


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = jaccard_components(docs, n=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


#: DuckDB: all pairs of sets that share a shingle, then what each set reaches. A set is known by a digest of its sorted shingles.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_sort(list_distinct(
    list_transform(list_zip(words[:-3], words[2:-2], words[3:]), lambda x: x[1] || ' ' || x[2] || ' ' || x[3]))) END AS shingles FROM w
), d AS MATERIALIZED (
  SELECT doc_id, shingles, len(shingles) AS n, CASE WHEN len(shingles) > 0 THEN md5(array_to_string(shingles, chr(10))) END AS cid FROM s
), c AS MATERIALIZED (
  SELECT cid, n, any_value(shingles) AS shingles FROM d WHERE cid IS NOT NULL GROUP BY cid, n
), g AS (
  SELECT cid, n, unnest(shingles) AS shingle FROM c
), l AS (
  SELECT a.cid AS a, b.cid AS b FROM g a JOIN g b ON a.shingle = b.shingle AND a.cid < b.cid
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT cid, cid AS other FROM c UNION SELECT r.cid, e.b FROM reach r JOIN e ON r.other = e.a
), k AS (
  SELECT r.cid, min(d.doc_id) AS component_id FROM reach r JOIN d ON r.other = d.cid GROUP BY r.cid
)
SELECT d.doc_id, d.n AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id FROM d LEFT JOIN k ON d.cid = k.cid
"""
