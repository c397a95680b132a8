"""Tables that are replaced whole by one rename of a small pointer, and caches that keep what came first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    """A file context of the path's store, whose renames can replace a file in one step, and a maker of paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the version that the pointer names; none if nothing was published."""
    files, place = _files(spark, path)
    if not files.util().exists(place(f"{path}/{POINTER}")):
        return None
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def write_version(df: DataFrame, path: str) -> str:
    """Writes a version that no reader sees yet; its name."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{name}")
    return name


def point_to(spark: SparkSession, path: str, name: str) -> None:
    """Lets readers see a version: a pointer is written aside and takes the place of the old one by one rename.

    Of two writers the last to rename wins; a writer that dies before it leaves the old pointer as it is.
    """
    files, place = _files(spark, path)
    aside = f"{path}/.{POINTER}-{name}"
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(aside)
    jvm = spark.sparkContext._jvm
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    part = next(f for f in (x.getPath().toString() for x in files.util().listStatus(place(aside))) if "/part-" in f)
    files.rename(place(part), place(f"{path}/{POINTER}"), overwrite)
    files.delete(place(aside), True)


def replace(df: DataFrame, path: str) -> str:
    """Publishes a table's new content whole; the name of its version."""
    name = write_version(df, path)
    point_to(df.sparkSession, path, name)
    return name


def read(spark: SparkSession, path: str) -> DataFrame:
    """The published version; FileNotFoundError without any."""
    name = current(spark, path)
    if name is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/versions/{name}")


def insert_absent(new: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Adds rows whose key a cache doesn't have yet, and reads it: what is there stays; of new rows of one key the first by `order`.

    The cache is one version after another: rows are read, joined by an anti join and published whole.
    """
    spark = new.sparkSession
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    if current(spark, path) is not None:
        old = read(spark, path)
        first = old.unionByName(first.join(old.select(key), key, "left_anti"))
    replace(first, path)
    return read(spark, path)


def cached_rewrites(questions: DataFrame, path: str, rewriter) -> DataFrame:
    """(query_id, text): each question's rewrite by its text, from the cache or, for texts that it hasn't, from rewriter(questions).

    rewriter: (query_id, text) to (query_id, text). A null or blank rewrite isn't kept, and the question itself is used.
    """
    spark = questions.sparkSession
    asked = questions.select("query_id", F.col("text").alias("question"))
    known = read(spark, path).select("question") if current(spark, path) is not None else asked.select("question").limit(0)
    missing = asked.where("question IS NOT NULL").join(known, "question", "left_anti")
    new = rewriter(missing.select("query_id", F.col("question").alias("text"))).select("query_id", F.col("text").alias("rewrite"))
    fresh = missing.join(new, "query_id").where("trim(rewrite) <> ''").select("question", "rewrite")
    cache = insert_absent(fresh, path, "question", "rewrite")
    return asked.join(cache, "question", "left").select("query_id", F.coalesce("rewrite", "question").alias("text"))
