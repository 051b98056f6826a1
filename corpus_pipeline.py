"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and reread before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import decontaminate, neardup, packing, pii, toxicity
from stemma.llm.common import staged, table

#: SQL cannot express the network of the first stage; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go. It learns from the labels of the documents it is given."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts the one with the least doc_id stays, in one row; rows without a doc_id stay.

    A doc_id on rows with different texts may stay with several.
    """
    # Which rows stay is decided on ids and hashes; whole rows are moved once, to meet that, as one value each.
    first = neardup.first_texts(docs).toDF("first_id", "f1", "f2", "repeated")
    k1, k2 = neardup.text_keys(F.col("text"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), k1.alias("k1"), k2.alias("k2"))
    kept = keyed.join(first, (F.col("id") == F.col("first_id")) & (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")))
    if first.where("repeated").limit(1).count():
        kept = kept.where("not repeated").unionByName(kept.where("repeated").dropDuplicates(["id", "k1", "k2"]))
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; all documents stay, and n_chars follows."""
    out = pii.redact(pii.find(docs.select(F.struct("*").alias("row"), "text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096, piece by piece, with their ids."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
