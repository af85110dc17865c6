"""The registered queries on a written sample with odd rows and clashing columns, against plain versions of their contracts."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.llm import decontaminate, licenses, packing, pii, queries, url_filter
from skirmish.llm.common import tune

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
WORD, LETTERS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    tune(spark)
    rng = random.Random(77)
    folder = str(tmp_path_factory.mktemp("sf"))

    def prose(n, v=300):
        return " ".join(f"w{rng.randrange(v)}" for _ in range(n))

    texts = [prose(rng.choice([1, 20, 60, 120])) + (" vile nasty vile" if i % 4 == 0 else "") for i in range(90)]
    texts += [texts[1], texts[1].upper(), None, "", " \n\t ", "one", "Mail a.b@c.example.org or 10.0.0.255, 4111 1111 1111 1111, +1 (555) 010-9999.", "long stop. " * 9000]
    texts += ["Released under the MIT License. " + prose(9) + " apache license", "x " + " ".join(f"rem {w}" if k % 6 == 0 else w for k, w in enumerate(licenses.NOTICES[0][1].split()))]
    base = prose(60, 9000).split()
    texts += [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 50, 10)]
    rows = [(i, t, "en", "a", 1, 5, "x") for i, t in enumerate(texts)] + [(3, texts[3], "en", "a", 1, 5, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id int, _row string"
    spark.createDataFrame(rows, schema).withColumns({c: F.lit("c") for c in ("shard", "pid", "score", "cid", "key", "digest")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, texts[5]), (2, None), (3, "")], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    urls = [f"https://{h}/{p}/{i % 5}" for i, (h, p) in enumerate(itertools.product(["Blog.example.com", "a.net", "b.org", "example.net", "z.info", "example.com"], ["en", "de", "es", "fr", "en/7"] * 8))]
    urls += [None, "", "no scheme", "http://", "HTTP://example.com?x#/en/", "https://b.org/" + "es/" * 20_000, urls[0]]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"row": F.lit(1), "token": F.lit(2)}).write.parquet(f"{folder}/pages.parquet")
    centre = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(6)]
    vectors = [[x + rng.gauss(0, s) for x in centre[k % 6]] for k in range(80) for s in [0.05 * (1 + k % 4)]]
    vectors += [vectors[0], [2 * x for x in vectors[0]], None, [0.0] * 32, [float("nan")] * 32, [], [1.0], [None] * 32]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").withColumn("cid", F.lit(1)).write.parquet(f"{folder}/embeddings.parquet")
    return folder, [(i, t) for i, t, *_ in rows], urls, vectors


def run(spark, sample, name):
    return queries.QUERIES[name](spark, sample[0]).collect()


def crc(i):
    return zlib.crc32(str(i).encode())


def test_vectors_link_as_cosines_say(spark, sample):
    sound = [(i, np.array(v, float)) for i, v in enumerate(sample[3]) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    root = {i: i for i in range(len(sample[3]))}
    links = dict.fromkeys(root, 0)
    for (i, a), (j, b) in itertools.combinations(sound, 2):
        if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95:
            links[i] += 1
            links[j] += 1
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if r == old else r for k, r in root.items()}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in run(spark, sample, "op1_embedding_dedup")}
    assert got == {i: (links[i], root[i], root[i] == i) for i in root}


def test_shards_are_near_equal_and_gapless(spark, sample):
    got = run(spark, sample, "op2_sharding")
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in sample[1])
    for shard, rows in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert 0 <= shard < 16 and [r.slot for r in rows] == list(range(sum(r.shard == shard for r in got)))


def test_toxic_texts_score_higher(spark, sample):
    got = run(spark, sample, "op3_toxicity")
    assert len(got) == len(sample[1]) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 90]
    assert min(r.score for r in held if r.doc_id % 4 == 0) > max(r.score for r in held if r.doc_id % 4)


def test_items_of_any_id_are_found(spark, sample):
    got = {(r.doc_id, r.item_id) for r in run(spark, sample, "op4_decontamination")}
    assert (5, 1) in got and {i for _, i in got} == {1}


def test_base_scores_are_those_of_counts(spark, sample):
    got = run(spark, sample, "op5_lm_score")
    words = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in sample[1]}
    train = [w for i, t in sample[1] if crc(i) % 10 for w in [*WORD.findall((t or "").translate(LOWER)), None]]
    counts = {}
    for w in train:
        counts[w] = counts.get(w, 0) + 1
    for r in got:
        want = sum(math.log10((counts.get(w, 0) + 0.1) / (len(train) + 0.1 * (len(counts) + 1))) for w in words[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 10 == 0, len(words[r.doc_id]), sum(w in counts for w in words[r.doc_id]), len(train))
        assert r.base_score == pytest.approx(want) and math.isfinite(r.score) and r.score <= 0


def url_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def test_urls_follow_the_longest_rule_and_enumerated_ones(spark, sample):
    got = {r.page_id: r for r in run(spark, sample, "op6_url_filter")}
    baskets, free = [], {}
    for i, url in enumerate(sample[2]):
        host, path = url_parts(url)
        fits = [(len(h + p), h + p, what) for what, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and (not rule or got[i].verdict == verdict)
        labels = [x for x in host.split(".") if x]
        tokens = {*(f"h:{x}" for x in labels), "top:" + host.split(".")[-1], *(f"p{k}:" + re.sub(r"\d+", "#", x.lower()) for k, x in enumerate(y for y in path.split("/") if y))}
        if rule:
            baskets.append((frozenset(list(tokens)[:99999]), verdict == "block"))
        else:
            free[i] = tokens
    # enumerated: all combinations of tokens of the labelled addresses
    short = [(frozenset(t for t in b if not re.match(r"p\d{2,}:", t)), y) for b, y in baskets]
    least, many = max(url_filter.SUPPORT * len(short), url_filter.LEAST), {}
    for b, y in short:
        for n in range(1, 6):
            for part in itertools.combinations(sorted(b), n):
                seen = many.setdefault(part, [0, 0])
                seen[0] += 1
                seen[1] += y
    rate = sum(y for _, y in short) / len(short)
    common = {p[0] for p, (n, _) in many.items() if len(p) == 1 and n > url_filter.COMMON * len(short)}
    rules = {p for p, (n, k) in many.items() if k >= least and k / n >= url_filter.CONFIDENCE and k / n / rate >= url_filter.LIFT and not common & set(p)}
    rules = {p for p in rules if any(t.startswith(("h:", "top:")) for t in p) and any(re.match(r"p\d+:", t) for t in p)}
    for i, tokens in free.items():
        assert got[i].verdict == ("block" if any(tokens.issuperset(p) for p in rules) else "allow"), sample[2][i]


def test_pieces_hold_every_id_once(spark, sample):
    encode = packing.Encoder()
    want = {}
    for i, t in sample[1]:
        want.setdefault(i, []).append(np.append(encode(t or ""), np.uint32(1)))
    got = run(spark, sample, "op7_packing")
    for i, copies in want.items():
        mine = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == i)
        cut = sorted((a, n, zlib.crc32(copies[0][a : a + n].astype("<u4").tobytes()), len(copies[0])) for a, n, _, _ in mine)
        assert mine == cut and sum(n for _, n, _, _ in mine) == sum(map(len, copies))
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        rows = list(rows)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 2048


def test_cuts_do_not_depend_on_blocks():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50, int(rng.integers(1, 900))) for _ in range(300)]
    stops = np.zeros(50, bool)
    stops[:3] = True

    def ends(block):
        packer = packing.Packer(stops, 512, block)
        rows = [x for k, ids in enumerate(docs) for x in packer.add(k, ids)] + packer.solve(True)
        return [(x[0], x[1], len(x[2]), x[4], x[5]) for x in rows]

    assert ends(1) == ends(5000) == ends(1 << 30)


def test_base_spans_and_their_digest(spark, sample):
    for r in run(spark, sample, "op8_pii"):
        text = dict(sample[1])[r.doc_id] or ""
        base = pii.base_spans(text)[0]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)] and {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(",")) | {""}
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in run(spark, sample, "op8_pii")) >= 4


def test_reliabilities_are_found_again():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(20_000) < 0.2, 0, np.where(rng.random(20_000) < right, 1, -1) * np.where(truth, 1, -1)) for right in (0.95, 0.8, 0.7)], 1)
    kinds, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, table, prior = pii.estimate(kinds, n.astype(float))
    assert abs(prior - 0.4) < 0.05 and abs(table[0, 1, 2] / (table[0, 1, 2] + table[0, 1, 0]) - 0.95) < 0.04
    assert ((p[which.ravel()] >= 0.5) == truth).mean() > 0.9


def test_base_phrases_and_notices_with_inserted_or_missing_words(spark, sample):
    for r in run(spark, sample, "op9_licenses"):
        words = LETTERS.findall((dict(sample[1])[r.doc_id] or "").translate(LOWER))
        at, names = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            at += found
            names |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)))
        assert names <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    scanner = licenses.Scanner({})
    rng = random.Random(4)
    for label, text, must in licenses.NOTICES:
        words = text.split()
        keep = {k for m in must for i in range(len(words)) if " ".join(words[i:]).startswith(m) for k in range(i, i + len(m.split()))}
        spare = [k for k in range(len(words)) if k not in keep]
        lost = set(rng.sample(spare, min(len(spare), int(0.25 * len(words)))))
        assert label in scanner(" ".join("qq" if k in lost else w for k, w in enumerate(words)))[3]
        assert label in scanner("a b " + " ".join(w + " zz" * (k % 5 == 4 and k not in keep) for k, w in enumerate(words)))[3]
    assert scanner("the software is free and you may use it under the terms of this license " * 20)[3] == set()


def test_shingle_sets_link_as_counts_say(spark, sample):
    sets = []
    for i, t in sample[1]:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(3, len(w))
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()))
    root = {i: i for i, _ in sets}
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 90 * len(a | b):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = {k: new if r == old else r for k, r in root.items()}
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in run(spark, sample, "op10_parity_join"))
    assert got == sorted((i, len(s), root[i]) for i, s in sets)


def test_groups_just_below_the_threshold_stay_apart(spark):
    from skirmish.llm import parity_join

    rng = random.Random(6)
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):  # pairs at about 0.79, where 0.8 links
        copy = list(base)
        for k in rng.sample(range(0, 300, 15), 6):
            copy[k] = f"e{i}-{k}"
        rows.append((i, " ".join(copy)))
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=80).collect()
    sets = [{tuple(t.split()[k : k + 3]) for k in range(298)} for _, t in rows]
    root = list(range(60))
    for i, j in itertools.combinations(range(60), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    assert sorted((r.id, r.component_id) for r in got) == list(enumerate(root))


@pytest.mark.parametrize("kind", ["smallint", "string", "decimal(10,0)"])
def test_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, "some words stand here for the join"), (2, "some words stand here for the join"), (3, None)], "doc_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    items = spark.createDataFrame([(7, "some words stand here for the join")], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    from skirmish.llm import lm_score, parity_join

    assert {str(r.id) for r in decontaminate.contaminated(docs, items).collect()} == {"1", "2"}
    assert {(str(r.id), str(r.component_id)) for r in parity_join.jaccard_components(docs).collect()} == {("1", "1"), ("2", "1"), ("3", "3")}
    assert len(lm_score.score_texts(docs.select(F.col("doc_id").alias("id"), F.lit(True).alias("train"), "text")).collect()) == 3
    assert len(packing.pack(docs).collect()) == 3 and len(licenses.scan(docs).collect()) == 3 and len(pii.detect(docs).collect()) == 3


def test_a_bucket_of_vectors_gives_a_forest():
    from skirmish.llm import embedding_dedup as dedup

    rng = np.random.default_rng(8)
    near = rng.standard_normal(48) + 0.03 * rng.standard_normal((300, 48))
    rows = np.concatenate((rng.standard_normal((1, 48)), near))
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    import pyarrow as pa

    batch = pa.record_batch([pa.array(range(len(x))), pa.array([list(v) for v in x])], ["cid", "vector"])
    coded = [(0, *r.values()) for b in dedup._coded([batch]) for r in b.to_pylist()]
    edges = list(dedup._Bucket(coded).edges(0.95))
    assert len(edges) < len(x) and len({frozenset(e) for e in edges}) == len(edges) >= 299


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same_rows(spark, sample, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sample[0]}/{table}.parquet/*.parquet')")
    found = con.execute(queries.ORACLE[name])
    names = [c[0] for c in found.description]
    want = sorted((dict(zip(names, r)) for r in found.fetchall()), key=str)
    rows = run(spark, sample, name)
    assert set(names) == set(rows[0].asDict()) and sorted(({c: r[c] for c in names} for r in rows), key=str) == want
