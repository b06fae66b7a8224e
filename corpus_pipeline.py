"""Corpus cleaning in five stages, each written as Parquet and read again by the next one.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, jaccard_join, langid, pii, toxicity
from strandline.llm.scratch import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out(F.col("doc_id"), 4, 2))
    return toxicity.accepted(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return jaccard_join.representatives(docs, n=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms replaced by their kind."""
    return pii.sanitised(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, the digest of what they decode to, and whether that is the text again."""
    return bpe.round_trips(docs, kept=tuple(c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("tokens", tokens)]

#: A trained model decides, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
