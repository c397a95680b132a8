"""A training corpus from documents: bad text out, near copies out, repeated passages out, sources mixed, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import bpe, minhash, mixing, passages, zstd_quality
from quaestor.llm.common import documents, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression classifier predicts to be good."""
    model = zstd_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return zstd_quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (shingles of five words, 0.8).

    Of rows with one id the one with the greatest text stays; rows without an id are in no group and stay.
    """
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    named = docs.select(*COLUMNS).where("doc_id IS NOT NULL").join(kept.hint("merge"), "doc_id", "left_semi")
    single = named.groupBy("doc_id").agg(F.max(F.struct(*rest)).alias("row")).select("doc_id", "row.*")
    return single.select(*COLUMNS).unionAll(docs.select(*COLUMNS).where("doc_id IS NULL"))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has too; a document that loses all of its words goes."""
    return passages.without_repeats(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each time that a document's words are taken."""
    return mixing.mixed_texts(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, their number, and whether they decode to the text."""
    out = bpe.encode_and_check(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.drop("text")


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("substring dedup", passage_dedup), ("mixing sources to target weights", mix), ("byte-level BPE", encode)]

#: Compression, hashing and byte-pair merges are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
