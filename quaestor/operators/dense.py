"""Exact search by inner product over (id, vector) tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block at most; a smaller table of vectors has PARTS blocks, or blocks of LEAST vectors.
BLOCK, LEAST, PARTS = 16_384, 1024, 32
#: Scores that a task holds at once.
SCORES = 4_000_000


def metadata_filter(**wanted) -> Column:
    """All columns that are given (not None) equal their values; without any, everything passes."""
    parts = [F.col(k) == v for k, v in wanted.items() if v is not None]
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query, rank from 1, ties by id; Spark limits groups before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a block of vectors for each of a block of queries, in slices of queries."""
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": queries["query_id"][:0], "id": vectors["id"][:0], "score": np.zeros(0)})
    vectors = vectors.sort_values("id", ignore_index=True)  # a stable sort of scores then breaks ties by id
    ids, matrix = vectors["id"].to_numpy(), np.array(vectors["vector"].tolist(), dtype=np.float64).T
    out, step = [], max(1, SCORES // len(vectors))
    for at in range(0, len(queries), step):
        part = queries.iloc[at : at + step]
        s = np.round(np.array(part["vector"].tolist(), dtype=np.float64) @ matrix, 6) + 0.0
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), best.shape[1]), "id": ids[best.ravel()], "score": np.take_along_axis(s, best, axis=1).ravel()}))
    return pd.concat(out, ignore_index=True)


def search(vectors: DataFrame, queries: DataFrame, k: int, on: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each query, ties by id; with `on`, of the vectors with the query's own value (also null) there.

    Queries and vectors are dealt to blocks by a hash of their ids, and each pair of blocks is one matrix product that
    keeps k for each query; a window keeps k of those. Both tables are read once and pass no driver, whatever
    the number of queries or of values of `on`.
    """
    n = vectors.count()
    width, height = max(1, -(-n // max(LEAST, min(BLOCK, n // PARTS)))), max(1, -(-queries.count() // BLOCK))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [F.col(on).isNull().alias("_null"), F.coalesce(F.col(on).cast("string"), F.lit("")).alias("_on")] if on else []
    left = queries.select("query_id", "vector", *own).withColumn("_q", dealt("query_id", height)).withColumn("_v", every(width))
    right = vectors.select("id", "vector", *own).withColumn("_v", dealt("id", width)).withColumn("_q", every(height))
    keys = ["_q", "_v", *(("_null", "_on") if on else ())]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(vectors.dtypes)['id']}, score double"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda q, v: _best(q, v, k), schema)
    return top_k(found, k)
