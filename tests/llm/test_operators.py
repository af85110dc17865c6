"""Each training-data operator against a brute-force version, and on odd input: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skirmish.llm import common, decontaminate, embedding_dedup, licenses, lm_score, packing, parity_join, pii, sharding, toxicity, url_filter
from skirmish.llm.common import connected_components, tune, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and blank texts, a very long one, and repeated rows."""
    return [(1, None, None, None, None), (None, "some words here", "en", "a", 3), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, "Same text, twice over.", "en", "a", 9), (4, "Same text, twice over.", "en", "a", 9), (5, "long " * 60_000, "en", "b", 1)]


@pytest.fixture(autouse=True)
def tuned(spark):
    tune(spark)


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    # columns that clash with results' names
    return df.withColumns({"size": F.lit("x"), "shard": F.lit("x"), "id": F.lit(7), "score": F.lit("y"), "cid": F.lit(1)}) if extra else df


def test_words_are_parted_as_the_contract_says():
    text = "Ab\x0bC É x\x1cy\r\n z\x85w İ"
    assert [w.decode() for w in words_of(text)] == words(text)


def test_components_of_a_chain_and_a_star(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, k) for k in range(101, 160)] + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and all(got[k] == 100 for k in range(100, 160))
    assert connected_components(edges.limit(0)).count() == 0


# ---- parity join


def jaccard_roots(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = words(t)
        k = min(n, len(w))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if k else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return sorted(((i, len(s), least.get(find(x), i)) for x, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_parity_join_finds_what_all_pairs_find(spark, n, num):
    rng = random.Random(n)
    rows = []
    for k in range(12):
        base = prose(rng, rng.choice([4, 12, 30, 60, 150]), 5000).split()
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((len(rows), " ".join(copy)))
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "n_shingles": F.lit(0)})
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(df, n=n, num=num).collect()), key=str)
    assert got == jaccard_roots(rows, n, num, 100)


def test_parity_join_parts_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    rng = random.Random(5)
    base = prose(rng, 80, 9000).split()
    rows = []
    for i in range(25):
        copy = list(base)
        copy[rng.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(copy)))
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90).collect()), key=str)
    assert got == jaccard_roots(rows, 3, 90, 100)


def test_parity_join_on_odd_rows_and_none(spark):
    got = parity_join.jaccard_components(frame(spark, odd_rows())).collect()
    assert len(got) == 7 and {r.component_id for r in got if r.id == 4} == {4}
    assert parity_join.jaccard_components(frame(spark, odd_rows()).limit(0)).count() == 0


def test_sketches_bound_the_difference_and_share_a_piece():
    rng = np.random.default_rng(3)
    bands = parity_join.Bands(80, 100)
    for _ in range(60):
        n = int(rng.integers(10, 700))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lost = int(rng.integers(0, max(1, len(a) // 9)))
        b = np.unique(np.concatenate((a[lost:], rng.integers(0, 2**63, lost).astype(np.uint64))))
        flat = parity_join.folded([parity_join.sketch(a), parity_join.sketch(b)])
        assert np.bitwise_count(flat[0] ^ flat[1]).sum() <= len(np.setxor1d(a, b))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
            keys, owner = parity_join.piece_keys(np.concatenate((a, b)), np.array([len(a), len(b)]), bands)
            assert set(keys[owner == 0]) & set(keys[owner == 1])


# ---- sharding


def test_shards_are_contiguous_and_even(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([0, 3, 40, 300])), "en", "a", 0) for i in range(500)] + odd_rows()[:4] + [(77, "hot", "en", "a", 3)] * 300
    df = frame(spark, rows).repartition(5)
    sized = df.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"))
    got = sharding.shard_by_bytes(sized, "size", ["doc_id", "size"], 16).collect()
    assert len(got) == len(rows)
    total, longest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(16):
        mine = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 16) <= longest
    order = [(-1 if r.doc_id is None else r.doc_id) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.shard_by_bytes(sized.limit(0), "size", ["doc_id"]).count() == 0


def test_shards_can_be_written(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string").withColumn("size", F.length("text").cast("long"))
    sharding.write_shards(sharding.shard_by_bytes(rows, "size", ["doc_id"], 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and back.select("shard").distinct().count() == 4


# ---- toxicity


def brute_segments(s):
    """All maximal scoring segments, by their definition: repeatedly the best segment, then both sides of it."""
    best, at = 0, None
    for i in range(len(s)):
        total = 0
        for j in range(i, len(s)):
            total += s[j]
            if total > best:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return brute_segments(s[:i]) + [(best, i, j)] + [(v, a + j, b + j) for v, a, b in brute_segments(s[j:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 1000 for _ in range(rng.randrange(14))]
        want = [(i, sum(x > 0 for x in s[a:b])) for i, (_, a, b) in enumerate(brute_segments(s))]
        got = toxicity.segments(np.array(s))
        assert sorted((a, b) for _, a, b in got) == sorted((a, b) for _, a, b in brute_segments(s)), (s, want)


def test_toxic_texts_score_higher_on_held_out_rows(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(rng, 60, 300).split()
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "nasty", "foulest"]))
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, int(toxic)))
    texts = frame(spark, rows).select(F.col("doc_id").alias("id"), "text")
    known = spark.createDataFrame(labels + [(None, 1), (5000, None), (0, 1)], "id long, toxic int")
    model = toxicity.train(texts.where(toxicity.fold("id", 4) != 2), known)
    got = {r.id: r.score for r in toxicity.score(texts, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in held) and len(held) > 60
    odd = frame(spark, odd_rows())
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd.select(F.col("doc_id").alias("id"), "text"), model).collect())
    assert toxicity.without_toxic(odd, model).count() == 7 and toxicity.without_toxic(odd, model).columns == odd.columns
    assert toxicity.score(texts.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    texts = frame(spark, odd_rows()).select(F.col("doc_id").alias("id"), "text")
    assert toxicity.train(texts, spark.createDataFrame([], "id long, toxic int")) is None
    assert {r.score for r in toxicity.score(texts, None).collect()} == {0.0}


# ---- decontamination


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        diagonal, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (p != t))
    return min(row)


def test_myers_distance_is_the_edit_distance():
    rng = random.Random(6)
    for _ in range(150):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 20)))
        masks = decontaminate._masks(p)
        assert decontaminate.best_end(p, masks, t)[0] == edit_distance_in(p, t)


def test_every_occurrence_within_the_budget_is_found(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, 25, 900)) for k in range(6)] + [(6, None), (7, ""), (1, "a repeated identifier with words of its own")]
    rows = []
    for i in range(60):
        text = prose(rng, 50, 900)
        if i % 3 == 0:
            item = list(decontaminate.squeezed(items[i % 6][1]))
            for _ in range(rng.randrange(0, len(item) // 8)):
                item[rng.randrange(len(item))] = rng.choice("xyz ")
            text = text[:80] + " " + "".join(item).upper() + "\n" + text[80:]
        rows.append((i, text, "en", "a", 0))
    got = {(r.id, r.item_id, r.distance) for r in decontaminate.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_bytes=300).collect()}
    want = set()
    for i, text, *_ in rows:
        for k, item in items:
            if q := decontaminate.squeezed(item):
                d = edit_distance_in(q, decontaminate.squeezed(text))
                if d <= decontaminate.budget(q):
                    want.add((i, k, d))
    assert got == want and len(want) > 10
    kept = decontaminate.without_leaks(frame(spark, rows + odd_rows()), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.count() == 67 - len({i for i, _, _ in want})
    assert decontaminate.contaminated(frame(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


# ---- language model


def test_probabilities_of_words_sum_to_one_at_most():
    rng = random.Random(8)
    words_ = [("".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))).encode() for _ in range(300)]
    n = np.zeros((2, lm_score.SLOTS), np.float32)
    for w in words_:
        bits = lm_score.Bits([w])
        for slot in bits.slots:
            np.add.at(n, (bits.y.astype(int), slot), 1)
    mixer = lm_score.Mixer(n[0], n[1]).learn(words_).freeze()
    every = [b""] + ["".join(t).encode() for k in range(1, 7) for t in __import__("itertools").product("ab", repeat=k)]
    total = (10.0 ** mixer.log10(every)).sum()
    assert 0.8 < total <= 1 + 1e-6
    assert mixer.log10([b"ab"])[0] > mixer.log10([b"zq"])[0]


def test_base_scores_and_better_ones(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "of", "And", "house", f"r{rng.randrange(3000)}"]) for _ in range(rng.choice([5, 80, 200]))), "en", "a", 0) for i in range(150)] + odd_rows()
    df = frame(spark, rows).select(F.col("doc_id").alias("id"), (toxicity.fold("doc_id", 10) != 0).alias("train"), "text")
    got = lm_score.score_texts(df).collect()
    train = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    want = sorted(round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6) for _, t, *_ in rows)
    assert [round(x, 6) for x in sorted(r.base_score for r in got)] == pytest.approx(want, abs=1e-5)
    assert all(r.train_tokens == n and r.score <= 0 and math.isfinite(r.score) for r in got)
    held = [r for r in got if not r.train]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.score_texts(df.limit(0)).count() == 0


# ---- URL rules


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.com/en/7?x", "https://b.example.net/de/81#t", "http://x.net/de/5", "http://y.org/es/", "nothing", None, "http://com/en/", "ftp://q.com:80/en/1", "http://badcom/en/", "http://EXAMPLE.ORG?/es/", "://h/p/es/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit("x"), "row": F.lit(3)})
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(rows).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("b.example.net", "/de/81", "example.net/de/8", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("org/es/", "block")
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[6][2:] == ("com/en/", "block") and got[7][0] == "q.com:80" and got[7][2] is None
    assert got[8][2] is None and got[9][:2] == ("example.org", "") and got[10][:2] == ("h", "/p/es/")
    assert url_filter.judged(rows.limit(0)).count() == 0


def test_mined_rules_join_host_and_path(spark):
    rows = [(["h:a", "top:com", "p0:en"], "block")] * 40 + [(["h:b", "top:net", "p0:de"], "allow")] * 40 + [(["h:a", "top:com", "p0:fr"], "allow")] * 9
    found = url_filter.mined(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()
    assert found and all("p0:en" in r.tokens and len(r.tokens) >= 2 and r.confidence >= 0.85 for r in found)


def test_rules_of_four_tokens_are_kept(spark):
    whole = ["h:a", "h:b", "p0:c", "p1:d"]
    rows = [(whole, "block")] * 40
    for gone in whole:  # every part is less sure than the whole
        rows += [([x for x in whole if x != gone], "allow")] * 10
    found = [sorted(r.tokens) for r in url_filter.mined(spark.createDataFrame(rows + [(["h:z", "p0:z"], "allow")] * 40, "tokens array<string>, verdict string")).collect()]
    assert found == [whole]


# ---- packing


def test_cuts_are_the_cheapest():
    rng = random.Random(10)
    for _ in range(200):
        places, t = [], 0
        for _ in range(rng.randrange(1, 9)):
            t += rng.randrange(1, 8)
            places.append(t)
        penalties = [rng.choice([0.0, 2.0, 5.0]) for _ in places]
        best = math.inf
        for mask in range(1 << (len(places) - 1)):
            chosen = [i for i in range(len(places) - 1) if mask >> i & 1] + [len(places) - 1]
            at = [0] + [places[i] for i in chosen]
            if all(b - a <= 8 for a, b in zip(at, at[1:])):
                best = min(best, sum(8 - (b - a) for a, b in zip(at, at[1:])) + sum(penalties[i] for i in chosen))
        got = packing.cuts(places, penalties, 8)
        at = [0] + got
        assert sum(8 - (b - a) for a, b in zip(at, at[1:])) + sum(penalties[places.index(t)] for t in got) == best


def test_pieces_give_all_ids_back(spark):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(11)
    rows = [(i, ". ".join(prose(rng, 9) for _ in range(rng.choice([1, 5, 60]))), "en", "a", 0) for i in range(80)] + odd_rows() + [(99, "a <|endoftext|> b", "en", "a", 0)]
    got = packing.pack(frame(spark, rows).repartition(3), window=256).collect()
    pieces = {}
    for r in got:
        assert r.length == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r.ids_crc32
        pieces.setdefault((r.id, r.doc_tokens), []).append(r)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    want = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, *_ in rows)
    back = Counter()
    for (_, total), parts in pieces.items():
        parts.sort(key=lambda r: r.start)
        copies = len([p for p in parts if p.start == 0])
        if copies == 1:
            back[tuple(x for p in parts for x in p["ids"])] += 1
        else:
            back[tuple(parts[0]["ids"])] += copies
    assert back == want
    assert sum(r.length for r in got) / (256 * len(sequences)) > 0.9
    assert packing.pack(frame(spark, odd_rows()).limit(0)).count() == 0


# ---- personal data


def test_base_spans_are_the_patterns_matches():
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(12)
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "0001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (202) 555-0143", "+12", "é", " ", ".", "9" * 25, "a@b.c@d.e", "+1(((", "٣", "-"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[k]
                if ok:
                    want.append((m.start(), k, m.end()))
        assert pii.base_spans(text)[0] == sorted(want), text


def test_secrets_are_learned_and_masked(spark):
    rng = random.Random(13)
    rows = []
    for i in range(120):
        secret = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((100 + i, f"{prose(rng, 9)} token = \"{secret}\" {prose(rng, 5)} mail me.{i}@host.example.com {'x-y-z-' * 6}end", "en", "a", 0))
    df = frame(spark, rows + odd_rows())
    got = {r.id: r for r in pii.detect(df).collect()}
    assert all(got[i].n_email == 1 and "secret:" in got[i].spans for i in range(100, 220))
    text = rows[3][1]
    start = text.index("me.3@")
    assert got[103].base_sha256 == hashlib.sha256(f"email:{start}:{start + len('me.3@host.example.com')}".encode()).hexdigest()
    out = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert "[EMAIL]" in out[103] and "[SECRET]" in out[103] and out[1] in (None, "some words here")
    assert pii.masked(df).columns == df.columns and pii.detect(df.limit(0)).count() == 0


def test_long_runs_cost_their_length_once():
    import time

    t = time.time()
    pii.examined("a" * 400_000 + " " + "1" * 400_000 + "." * 10 + "@" * 50_000 + "1." * 100_000 + "+1" + "(" * 100_000)
    assert time.time() - t < 20


# ---- licenses


def test_phrases_and_notices(spark):
    texts = ["Released under the MIT License.", "mit-LICENSE, Apache license and GNU General Public License", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General\nPublic License, version 3.", "a general license for the public", "admit license", None, ""]
    got = {r.id: r for r in licenses.scan(frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(50 + i, prose(random.Random(i), 30), "en", "a", 0) for i in range(20)])).collect()}
    assert got[0].base_labels == "mit" and got[0].first_word == 3 and got[0].score == 1.0
    assert got[1].base_labels == "apache,gpl,mit" and got[1].n_base == 3 and (got[1].first_word, got[1].last_word) == (0, 6)
    assert got[2].base_labels == "" and "cc-by-nc" in got[2].labels and got[2].n_words == 7
    assert got[3].labels == "gpl" and got[4].labels == "" and got[5].labels == "" and got[4].score == 0
    assert got[6].n_words == 0 and got[6].first_word is None and got[7].labels == ""
    assert licenses.scan(frame(spark, odd_rows())).count() == 7 and licenses.scan(frame(spark, odd_rows()).limit(0)).count() == 0


# ---- embeddings


def vectors(seed, groups, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in groups:
        base = rng.standard_normal(dim)
        out += [base + noise * rng.standard_normal(dim) for _ in range(size)]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    vs = vectors(1, [(1, 0)] * 150 + [(40, 0.02), (7, 0.1), (25, 0.2), (3, 0.0)])
    rows = [(i * 3, v, 1) for i, v in enumerate(vs)]
    bad = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 32, 1), (9004, [1.0, None] + [0.0] * 30, 1), (9005, [float("nan")] * 32, 1), (9006, [float("inf")] + [0.0] * 31, 1), (9007, vs[0][:16], 1), (None, [2 * x for x in vs[5]], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit(1), "row": F.lit("x")})
    got = {r.id: r for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array(vs)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(link, root[None, :], 10**9).min(1))
    for i in range(len(x)):
        assert got[i * 3].n_links == link[i].sum() + (i == 5) and got[i * 3].component_id == root[i] * 3 and got[i * 3].kept == (root[i] == i)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9008))
    assert got[None].component_id == 15 and embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x, y = (rng.standard_normal((2000, 64)) for _ in range(2))
    y = 0.8 * x + 0.6 * y
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    code, factor = embedding_dedup.codes(x)
    true = (x * y).sum(1)
    bound = embedding_dedup.upper_bounds(code, factor, y, np.zeros(len(y)))
    assert (true <= bound).mean() > 0.995 and (bound - true).mean() < 0.4


# ---- running text


def test_word_order_and_words_before_count(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        out = []
        while len(out) < 60:
            k = rng.randrange(40)
            out += [f"w{k}", f"w{(7 * k + 3) % 40}", f"w{(11 * k + 5) % 40}"]
        rows.append((i, " ".join(out), "en", "a", 0))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10 == 0]
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), 60)), *rest) for i, t, *rest in held]
    df = frame(spark, rows + shuffled).select(F.col("doc_id").alias("id"), (F.col("id") != 7).alias("x"), "text")
    df = df.select("id", ((toxicity.fold("id", 10) != 0) & (F.col("id") < 1000)).alias("train"), "text")
    got = {r.id: r for r in lm_score.score_texts(df).collect()}
    assert len(held) > 10
    for (i, *_), (j, *_) in zip(held, shuffled, strict=True):
        assert got[i].base_score == pytest.approx(got[j].base_score)
        assert got[i].score > 0.8 * got[j].score and got[i].score > got[i].base_score
    assert sum(got[i].score for i, *_ in held) > 0.8 * sum(got[j].score for j, *_ in shuffled)


def test_mixer_learns_from_every_training_word(spark, monkeypatch):
    rng = random.Random(22)
    counts = {f"{rng.randrange(10**6)}x{i}".encode(): rng.randrange(1, 90) for i in range(3000)}  # over 60,000 occurrences
    rows = []
    for bucket in range(4):
        part = sorted(counts)[bucket::4]
        rows.append((bucket, lm_score._pack(b" ".join(part)), lm_score._pack(np.array([counts[w] for w in part], np.int64).tobytes()), len(part)))
    vocabulary = spark.createDataFrame(rows, "bucket long, words binary, counts binary, single long")
    weights, refined, paths = lm_score.train_mixer(vocabulary, 3)
    learned = vocabulary.groupBy("bucket").cogroup(paths.groupBy("bucket")).applyInArrow(lm_score._learned(3), "cell long, sum double, mass double")
    mass = learned.where(F.col("cell") < weights.size).agg(F.sum("mass")).first()[0]
    assert mass / weights.shape[1] == sum(8 * (len(w) + 1) * n for w, n in counts.items())
    assert np.isfinite(weights).all() and np.isfinite(refined).all() and not np.allclose(weights, 0.25)


def test_counts_of_contexts_are_exact_and_grow(spark):
    rng = random.Random(23)
    counts = {f"{rng.randrange(10**6)}y{i}".encode(): rng.randrange(0, 9) for i in range(900)}
    rows = []
    for bucket in range(3):
        part = sorted(counts)[bucket::3]
        rows.append((bucket, lm_score._pack(b" ".join(part)), lm_score._pack(np.array([counts[w] for w in part], np.int64).tobytes()), len(part)))
    vocabulary = spark.createDataFrame(rows, "bucket long, words binary, counts binary, single long")
    paths = lm_score.train_mixer(vocabulary, 4)[2].toArrow()
    for bucket in range(3):
        words_ = sorted(counts)[bucket::3]
        mine = paths.filter(np.array(paths["bucket"]) == bucket)
        got = lm_score._answered(words_, 4, mine)._counts(lm_score.Bits(words_), 0)
        prefixes, lasts = Counter(), Counter()
        for w, n in counts.items():
            bits = "".join(f"{c:08b}" for c in w + b" ")
            for k in range(len(bits)):
                prefixes[bits[: k + 1]] += n
                lasts[min(k // 8, 3), bits[max(0, k // 8 - 3) * 8 : k + 1]] += n
        at = 0
        for w in words_:
            bits = "".join(f"{c:08b}" for c in w + b" ")
            for k in range(len(bits)):
                for context, want in ((2, [prefixes[bits[:k] + c] for c in "01"]), (1, [lasts[min(k // 8, 3), bits[max(0, k // 8 - 3) * 8 : k] + c] for c in "01"])):
                    assert [got[context][0][at], got[context][1][at]] == want
                at += 1


def test_scores_do_not_depend_on_splits(spark):
    rng = random.Random(24)
    rows = [(i, prose(rng, rng.choice([0, 1, 40, 90]), 900), "en", "a", 0) for i in range(240)] + odd_rows()
    df = spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("id"), (toxicity.fold("doc_id", 10) != 0).alias("train"), "text")
    got = [sorted((r.id or -1, r.score) for r in lm_score.score_texts(df.repartition(k)).collect()) for k in (1, 5, 16)]
    for other in got[1:]:
        assert [i for i, _ in other] == [i for i, _ in got[0]] and np.allclose([x for _, x in other], [x for _, x in got[0]], rtol=1e-6)


def test_every_word_is_spelled():
    import pyarrow as pa

    words = [b"alpha", b"beta", b"gamma"]  # in four training texts, in two, in one
    table = pa.table({"bucket": [0], "words": [lm_score._pack(b" ".join(words))], "counts": [lm_score._planes(np.array([5, 3, 1]))], "texts": [lm_score._planes(np.array([4, 2, 1]))]})
    left = lm_score._summed(table)
    told = pa.Table.from_batches(lm_score._asking(2)(iter(left.select(["bucket", "words", "counts"]).to_batches())))
    right = pa.concat_tables([lm_score._sharded(told.filter(pa.compute.equal(told["shard"], k))) for k in sorted(set(told["shard"].to_pylist()))])
    learned = lm_score._learned(2)(left, right)
    assert learned.num_rows
    mixer = lm_score.Mixer(np.zeros(0), np.zeros(0))
    logs = np.frombuffer(lm_score._unpack(lm_score._logs(2, mixer.weights, mixer.refined)(left, right)["logs"][0].as_py()), np.float64)
    assert len(logs) == 3 and np.isfinite(logs).all() and (logs < 0).all()


def test_lm_score_holds_shares_of_a_bounded_number_of_texts():
    import tracemalloc

    n, rng = 20_000, np.random.default_rng(5)
    lengths = rng.integers(1, 4, n)
    p, gate = rng.random((lengths.sum(), lm_score.INPUTS)) * 0.1 + 1e-4, rng.integers(0, lm_score.GATES, lengths.sum())
    shares = rng.dirichlet(np.ones(lm_score.INPUTS), lm_score.GATES)
    tracemalloc.start()
    got = lm_score.text_scores(p, gate, lengths, shares)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # shares of all texts at once are 67 MB
    first = np.cumsum(lengths) - lengths
    for k in (0, 4095, 4096, n - 1):
        part = slice(first[k], first[k] + lengths[k])
        assert np.allclose(got[k], lm_score.text_scores(p[part], gate[part], lengths[k : k + 1], shares)[0])


def test_stored_tables_of_large_rows_have_small_row_groups(spark):
    import pyarrow.parquet as pq

    def run(batches):
        rng = np.random.default_rng(2)
        for _ in batches:
            for k in range(48):
                yield pa.record_batch([pa.array([k]), pa.array([rng.bytes(1 << 20)], pa.binary())], ["k", "blob"])

    kept = common.stored(spark.range(1).coalesce(1).mapInArrow(common.released(run), "k long, blob binary"), "test-groups")
    sizes = [m.row_group(k).total_byte_size for f in kept.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for k in range(m.num_row_groups)]
    assert sum(sizes) > 48 << 20 and max(sizes) < 2 * common.GROUP_BYTES
    assert kept.selectExpr("count(*)", "sum(k)", "min(length(blob))").first() == (48, 1128, 1 << 20)
    common.dropped(kept)


def test_a_map_hands_memory_back_when_it_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    passing = common.released(lambda batches: (2 * b for b in batches))([1, 2])
    assert next(passing) == 2 and not calls
    assert list(passing) == [4] and calls == [1]
