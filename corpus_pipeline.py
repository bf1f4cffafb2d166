"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and hands what it reads back to the next
stage. All but the last return the columns of ``documents``.

Nulls and repeats: a null text fails the quality rules; rows that share a
``doc_id`` are judged one by one, and near-dedup drops one of them only where
its own text is linked to one that stays; rows with a null ``doc_id`` are no
duplicates of any; columns beyond the usual ones pass through, whatever their
names. An empty table runs through to an empty packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _work as W
from tessera.llm import decontam, minhash, packing, quality, secrets

#: Words a shingle in the near-duplicate stage; links are at 0.8 (``minhash.LINK``).
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    return quality.keep_good(docs, quality.train(docs, W.labels(spark, sf_dir)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each near-duplicate group: that with the smallest id."""
    return minhash.keep_one(docs, SHINGLE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, W.benchmark(spark, sf_dir))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, each secret replaced by a mark; ``n_chars`` follows the text."""
    columns = docs.columns
    into = W.free_name(docs, "secrets")
    found = secrets.redact(secrets.scan(docs, into=into), into=into)
    if "n_chars" in columns:
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return found.select(*(F.col(f"`{c}`") for c in columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: Learned rules, signatures, alignment and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = W.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = W.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
