"""The corpus pipeline, stage by stage, on planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_each_stage_does_its_work(spark, tmp_path):
    rng = random.Random(1)

    def prose(n):
        return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))

    item = prose(30)
    rows, labels = [], []
    for i in range(160):
        toxic = i % 5 == 0
        text = prose(60) + (" vile nasty vile nasty vile" if toxic else "")
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, 1, int(toxic)))
    base = rows[1][1].split()
    rows += [(500 + k, " ".join([*base[:30], f"changed{k}", *base[31:]]), "en", "b", 1) for k in range(30)] + [(600 + k, rows[2][1], "en", "b", 1) for k in range(5)]
    rows += [(700, prose(20) + " " + item.upper() + " " + prose(9), "en", "a", 1), (800, "write to me.x@host.example.com " + prose(20), "en", "a", 1), (900, None, None, None, None), (901, "", "en", "a", 0)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        else:
            pieces = out.collect()
    clean = {i for i in range(160) if i % 5} | {*range(500, 530), *range(600, 605), 700, 800, 900, 901}
    # so few labels may cost a clean document or two
    assert set(kept["toxicity"]) <= clean and len(clean - set(kept["toxicity"])) <= 2
    clean = set(kept["toxicity"])
    assert {700, 800} <= clean
    group, copies = {1, *range(500, 530)}, {2, *range(600, 605)}
    assert len(group & set(kept["near_copies"])) == 1 and len(copies & set(kept["near_copies"])) == 1
    assert set(kept["near_copies"]) - group - copies == clean - group - copies
    assert set(kept["near_copies"]) - set(kept["decontamination"]) == {700}
    assert "[EMAIL]" in kept["pii"][800] and kept["pii"][900] is None
    assert {r.doc_id for r in pieces} == set(kept["pii"]) and all(len(r["ids"]) == r.length for r in pieces)


def test_the_pipeline_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
