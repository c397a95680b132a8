"""Places of rows in stored tables, joins by them, and digests that hang on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def positions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with `position`: 0, 1, ... without holes in the order of its files' names and of the rows in each.

    A row's index in its file is known to the reader; each file is moved by the rows of those before it. So the places are the
    same however the table is split into tasks.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = rows.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(files, "_file").withColumn("position", F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def join_by_position(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two tables of positions() at the same place; raises ValueError if one has more rows than the other."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows against {b}")
    return left.join(right, "position")


def check_index(spark: SparkSession, vectors: str, metadata: str, chunks: DataFrame, dimension: int) -> list[str]:
    """What is wrong with an index whose row i is the vector of row i of its metadata (chunk_id, ...): count, dimension, order, chunks.

    chunks: (chunk_id, position), the order that the metadata must have.
    """
    v, m = positions(spark, vectors), positions(spark, metadata)
    n = {name: df.count() for name, df in (("vectors", v), ("metadata rows", m), ("chunks", chunks))}
    found = [] if len(set(n.values())) == 1 else [", ".join(f"{x} {name}" for name, x in n.items())]
    found += [f"not all vectors have {dimension} components"] if v.where(F.coalesce(F.size("vector"), F.lit(-1)) != dimension).limit(1).count() else []
    moved = m.select("position", "chunk_id").join(chunks.select("position", F.col("chunk_id").alias("wanted")), "position", "full_outer").where("NOT chunk_id <=> wanted")
    wrong = [r.position for r in moved.orderBy("position").limit(3).collect()]
    return found + ([f"another chunk at {', '.join(map(str, wrong))}"] if wrong else [])


def digest_tree(rows: DataFrame, place: str, content: Column, by: list[str], fanout: int = 1024, levels: int = 3) -> DataFrame:
    """(by, fingerprint): a digest of each group's contents in the order of their places.

    A row's digest is that of its content; `fanout` neighbouring places have one of theirs in order, and so on, `levels` times. No
    group's contents ever stand in one string. Places are whole numbers from 0 under fanout ** levels, holes are allowed, and rows
    of one place are taken in the order of their digests. The result hangs on content and order, not on partitions.
    """
    limit = fanout**levels
    inside = F.when((F.col(place) >= 0) & (F.col(place) < limit), F.col(place).cast("long")).otherwise(F.raise_error(F.lit(f"a place isn't from 0 to {limit - 1}")).cast("long"))
    level = rows.select(*by, inside.alias("at"), F.sha2(F.coalesce(content, F.lit("")), 256).alias("digest"))
    for _ in range(levels):
        own = F.sort_array(F.collect_list(F.struct("at", "digest")))["digest"]
        level = level.groupBy(*by, F.floor(F.col("at") / fanout).alias("up")).agg(F.sha2(F.array_join(own, ""), 256).alias("digest")).withColumnRenamed("up", "at")
    return level.select(*by, F.col("digest").alias("fingerprint"))


def digest_tree_sql(rows: str, place: str, content: str, by: list[str], fanout: int = 1024, levels: int = 3) -> str:
    """DuckDB CTEs that end in `tree` (by, fingerprint), as digest_tree() gives it."""
    keys = "".join(f"{b}, " for b in by)
    out = f"tree0 AS (SELECT {keys}{place} AS spot, sha256(coalesce({content}, '')) AS digest FROM {rows})"
    for i in range(levels):
        out += f", tree{i + 1} AS (SELECT {keys}spot // {fanout} AS spot, sha256(string_agg(digest, '' ORDER BY spot, digest)) AS digest FROM (SELECT {keys}spot, digest FROM tree{i}) GROUP BY {keys}spot // {fanout})"
    return out + f", tree AS (SELECT {keys}digest AS fingerprint FROM tree{levels})"
