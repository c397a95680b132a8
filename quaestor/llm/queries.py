"""One query for each operator, with production parameters, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cross_polytope, divergence, fertility, hard_negatives, kdtree, licenses, lm, minhash, mixing, passages, url_rules, zstd_quality
from .common import documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(documents(spark, sf_dir), PIECES, RANKS, public_tokenizers.PATTERN)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    return lm.score(docs, target)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.known(spark))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.shard(documents(spark, sf_dir), shards=8)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle_words=2, percent=80)


def op10_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = zstd_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = zstd_quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(zstd_quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "size_difference")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(v, anchor="id % 100 = 0", positives=5, negatives=5, percent=80)


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_ALL = (op1_fertility, op2_mixing, op3_passages, op4_bpe, op5_lm, op6_licenses, op7_cross_polytope, op8_kdtree, op9_minhash, op10_zstd, op11_divergence, op12_hard_negatives, op13_url_rules)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {"op6_licenses": licenses.oracle(), "op11_divergence": divergence.oracle(), "op12_hard_negatives": hard_negatives.oracle(), "op13_url_rules": url_rules.oracle()}
