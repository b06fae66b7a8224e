"""The registered queries of this package, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hamming_topk, jaccard_join, langid, lm_scoring, pii, sharding, toxicity, url_filter

_EMPTY = hashlib.sha256(b"").hexdigest()


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    items = F.when(F.size("items") > 0, F.sha2(F.array_join(F.array_sort("items"), ","), 256)).otherwise(_EMPTY)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"))
    return url_filter.judge(_read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return hamming_topk.search(vectors, vectors.where("vec_id % 50 = 0"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 10, 0))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_read(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("group")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    scored = toxicity.scored(docs, toxicity.train(docs, labels.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_benchmark_decontamination, op2_url_filter, op3_hamming_topk, op4_pii, op5_bpe, op6_sharding, op7_language_id, op8_lm_scoring, op9_jaccard_join, op10_toxicity)}
ORACLES = {"op2_url_filter": url_filter.SQL, "op3_hamming_topk": hamming_topk.SQL}
