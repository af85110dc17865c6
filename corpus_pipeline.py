"""A corpus pipeline of five stages: toxic documents go, one document of each group of near copies stays, documents
with benchmark passages go, personal data is masked, and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. Null and empty texts pass the filters and pack as an end id
alone; repeated rows count as near copies of each other, and of each group the first row stays; extra columns go along,
whatever their names; rows with null ids stay as rows of their own. The order of rows within a split, and so the cuts of
the last stage, may differ from run to run; what is kept and masked does not.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm import decontaminate, packing, parity_join, pii, toxicity
from skirmish.llm.common import dropped, read_table, shared_dir, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3; the model learns from the labelled ones outside the held-out fold."""
    tune(spark)
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    model = toxicity.train(texts.where(toxicity.fold("id", 4) != 2), labels)
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more over five-word shingles hold together."""
    tune(spark)
    return parity_join.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget."""
    tune(spark)
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    tune(spark)
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents by sequence, with their token ids."""
    tune(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, sketches and dynamic programming have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for the documents of a data set."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:
                dropped(before)
    return docs
