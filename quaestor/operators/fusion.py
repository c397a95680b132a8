"""Rank fusion: reciprocal ranks of two rankings, in the three ways that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions.numeric import reciprocal_rank

ABSENT = 1_000_000


def ranked(scored: DataFrame, name: str, *ties: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *(ties or ("id",)))
    return scored.select("query_id", "id", F.row_number().over(w).alias(name))


def global_ranks(candidates: DataFrame, scored: DataFrame, name: str) -> DataFrame:
    """(query_id, id, name): the rank among all scored rows of those of the candidates that are scored, ties by id.

    A query's candidates, a bounded number, become a sorted list. Each scored row finds how many of them stand before
    it; rows are counted by that before the shuffle, and the running sum of these counts is a candidate's rank. So no task
    sorts all rows of a query.
    """
    place = F.struct((-F.col("score")).alias("down"), "id")
    lists = scored.join(candidates.select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.sort_array(F.collect_list(place)).alias("places"))
    before = scored.join(lists, "query_id").select("query_id", F.size(F.filter("places", lambda p: p < place)).alias("at")).groupBy("query_id", "at").agg(F.count("*").alias("n"))
    running = before.select("query_id", "at", F.sum("n").over(Window.partitionBy("query_id").orderBy("at")).cast("int").alias(name))
    return lists.select("query_id", F.posexplode("places").alias("at", "p")).join(running, ["query_id", "at"]).select("query_id", F.col("p.id").alias("id"), name)


def fuse_global(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Dense candidates with their lexical rank over the whole corpus; ties go to the better dense rank.

    dense: (query_id, id, score) of the candidates. lexical: (query_id, id, score) of documents that score above none.
    """
    return fuse_ranks(dense, global_ranks(dense, lexical, "lexical_rank"), k)


def fuse_ranks(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """The same by lexical ranks that are known: (query_id, id, lexical_rank) of those of the candidates that have one."""
    both = ranked(dense, "dense_rank").join(lexical, ["query_id", "id"], "left")
    both = both.withColumn("lexical_rank", F.coalesce("lexical_rank", F.lit(ABSENT)))
    return _best(both, k)


def fuse_candidates(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Dense candidates with their lexical rank among the candidates, ties in dense order."""
    both = ranked(dense, "dense_rank").join(lexical.withColumnRenamed("score", "lexical"), ["query_id", "id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("lexical", F.lit(0.0))), "dense_rank")
    return _best(both.withColumn("lexical_rank", F.row_number().over(w)).drop("lexical"), k)


def _best(both: DataFrame, k: int) -> DataFrame:
    both = both.withColumn("score", F.round(reciprocal_rank(F.col("dense_rank")) + reciprocal_rank(F.col("lexical_rank")), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "dense_rank")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse_lists(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """The sum of reciprocal ranks over the lists that have a document; ties go to the earlier list, then its rank."""
    rows = None
    for i, scored in enumerate(lists.values()):
        part = ranked(scored, "r").withColumn("list", F.lit(i))
        rows = part if rows is None else rows.unionAll(part)
    summed = rows.groupBy("query_id", "id").agg(F.round(F.sum(reciprocal_rank(F.col("r"))), 9).alias("score"), F.min(F.struct("list", "r")).alias("seen"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "id")
    return summed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def best_of_parent(hits: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, id, parent, rank): the best of each parent, then the k best parents."""
    inside = Window.partitionBy("query_id", "parent").orderBy("rank", "id")
    one = hits.withColumn("_n", F.row_number().over(inside)).where("_n = 1").drop("_n")
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    return one.withColumn("parent_rank", F.row_number().over(w)).where(F.col("parent_rank") <= k)
