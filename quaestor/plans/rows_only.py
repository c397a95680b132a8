"""Queries that SQL can't express; tests hold them against plain Python."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import text as T
from quaestor.functions import udfs
from quaestor.operators import evidence
from quaestor.sources import tables

from . import views as V
from .registry import query


@query()
def line_similarity(spark, sf_dir):
    """Neighbouring messages in normal form, by matching blocks."""
    m = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = m.withColumn("other", F.lead("line").over(w)).where("other IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(udfs.similarity(T.folded(F.col("line")), T.folded(F.col("other"))), 9).alias("similarity"))


@query()
def quote_span(spark, sf_dir):
    """The literal slice of a document for an edited quote."""
    d = V.table(spark, sf_dir, "documents")
    quote = F.concat(F.upper(F.substring("text", 11, 40)), F.lit(" … "), F.replace(F.substring("text", 71, 40), F.lit(" "), F.lit("  ")))
    return d.select("doc_id", udfs.quote_span(quote, "text").alias("found"))


@query()
def quote_repair(spark, sf_dir):
    """A quote's literal form in the first of its document's chunks that has one."""
    q = V.sections(spark, sf_dir).where("length(texto) > 120").select("doc_id", F.replace(F.substring("texto", 31, 60), F.lit(" "), F.lit("   ")).alias("quote"))
    j = q.join(V.chunks(spark, sf_dir).select("doc_id", "chunk_id", "posicion", "texto"), "doc_id").withColumn("found", udfs.quote_span("quote", "texto"))
    first = j.where("found IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", "found"), "posicion").alias("f"))
    return q.select("doc_id").join(first, "doc_id", "left").select("doc_id", "f.chunk_id", "f.found")


@query()
def best_literal_line(spark, sf_dir):
    """The document's line that scores best for a quote, if it is alone at the top."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 80).alias("quote"), "text")
    best = evidence.scored_lines(evidence.lines(evidence.quoted(d, "quote"), "text").drop("text"), "quote", "line")
    top = best.withColumn("r", F.rank().over(Window.partitionBy("doc_id").orderBy(F.desc("score")))).where("r = 1").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("line").alias("line"), F.max("score").alias("score"))
    return top.select("doc_id", F.when(F.col("n") == 1, F.col("line")).alias("line"), "score.similarity")


@query()
def file_hashes(spark, sf_dir):
    """Digests of all tables' files."""
    return tables.file_hashes(spark, f"{sf_dir}/*.parquet")


@query()
def accent_fold_full(spark, sf_dir):
    """Texts case-folded, without any accents by compatibility decomposition, by their digests."""
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(udfs.without_accents("text")).alias("digest"))
