"""Pieces that several operators share: words, stored tables, offsets, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a worker turns into Python objects at once; texts are long.
ROWS_AT_ONCE = 1000

_own_folder: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: str) -> list[bytes]:
    """The words of a text (None: none); bytes.split() parts at the same six characters as WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def map_parts(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As mapInPandas, but in parts of a batch, whatever size the session's batches have."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                yield batch.slice(at, ROWS_AT_ONCE).to_pandas(integer_object_nulls=True)

    def all_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(parts(batches)):
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return df.mapInArrow(all_parts, schema)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for shared intermediate tables; where a local session names none, a temporary one.

    A cluster without such a folder is an error: its executors would each write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quaestor-"))
    return _own_folder[0]


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and the work is done once."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(stored: DataFrame) -> None:
    """Deletes a table of store() that nothing reads any more, and lets Spark's cleaner take the shuffle files of finished plans.

    The cleaner deletes those of plans that the driver's collector has found dead; left alone, that may be half an hour.
    """
    spark = stored.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in stored.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


#: Rows of a chunk in with_offsets, about.
CHUNK_ROWS = 50_000


def with_offsets(df: DataFrame, key: str, order: list[str], size: str, rows: int) -> DataFrame:
    """Adds `start`: the sum of `size` over the rows that stand before this one under its (non-null) `key`.

    The order under a key is by a hash chunk of the first `order` column and then by `order`. Each chunk is summed
    by itself and moved by the sum of the chunks before it, so that a key with a third of all rows is spread over
    many groups: as many as `rows`, the number of df's rows, asks for.
    """
    chunks = max(64, rows // CHUNK_ROWS)
    df = df.withColumn("_chunk", F.pmod(F.xxhash64(order[0]), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    moved = df.groupBy(key, "_chunk").agg(F.sum(size).alias("_sum")).select(key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_moved"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(moved, [key, "_chunk"]).withColumn("start", F.col("_moved") + F.coalesce(F.sum(size).over(inside), F.lit(0))).drop("_chunk", "_moved")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph of `edges` (a, b): a row (id, component_id) for each id in an edge.

    component_id is the smallest id that can be reached. Alternates large-star and small-star steps until the edges
    stay as they are; all are grouped minima and joins, so a hub with many edges is pre-aggregated and its join can
    be split. Null ends and loops are left out.
    """
    e = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        before, e = e, store(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(before)
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
