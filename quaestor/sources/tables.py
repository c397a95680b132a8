"""Parquet, CSV and file scans, and sinks."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.schemas import FACT, RESULT, VECTOR

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for tables of its jobs; where a local session names none, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quaestor-"))
    return _own_folder[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back: what it was made from isn't computed again, also if executors go."""
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACT).parquet(path)


def read_vectors(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """Vectors by id; raises if any has another dimension."""
    v = spark.read.schema(VECTOR).parquet(path)
    if dimension is not None and v.where(F.size("vector") != dimension).limit(1).count():
        raise ValueError(f"not all vectors have {dimension} components")
    return v


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A detailed evaluation as CSV; empty fields are null. Columns are taken by name, missing ones are null."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    return raw.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT))


def write_results(df: DataFrame, path: str) -> None:
    """The fixed columns as one CSV part with a header; a null cost is written as 0, as readers of the table expect."""
    out = df.select(*(df[f.name] if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT))
    out.withColumn("coste_usd", F.coalesce("coste_usd", F.lit(0.0))).coalesce(1).write.mode("overwrite").csv(path, header=True)


#: Files of more bytes are read in blocks of BLOCK, others by Spark's own reader, whole.
WHOLE, BLOCK = 256 << 20, 1 << 20


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file under a path; a file is one task's, as its digest goes from its first byte to its last.

    A file of more than WHOLE bytes is read in blocks, through the file systems that Arrow knows, and never held whole. Files
    without bytes have no row, as Spark deals none of them to a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    small = files.where(F.col("length") <= WHOLE).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for place in batch["path"]:
                system, inside = pafs.FileSystem.from_uri(quote(place, safe=":/@"))
                digest = hashlib.sha256()
                with system.open_input_stream(inside, compression=None) as stream:
                    while block := stream.read(BLOCK):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"name": batch["name"], "bytes": batch["bytes"], "sha256": digests})

    large = files.where(F.col("length") > WHOLE).select("path", name, F.col("length").alias("bytes"))
    return small.unionAll(large.mapInPandas(run, "name string, bytes long, sha256 string"))


def write_audit(df: DataFrame, path: str) -> int:
    """Interventions of guards as JSON lines in a folder that is overwritten; their number. Without any, nothing is written."""
    if df.isEmpty():
        return 0
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return df.sparkSession.read.text(path).count()


def write_report(df: DataFrame, path: str) -> None:
    """A report's rows twice, under `path`: `csv` as one part with a header, for people, and `json` lines with nulls written out."""
    df.coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")


def find_corpus(spark: SparkSession, candidates: list[str], file: str = "chunks.jsonl") -> str:
    """The first of the folders that has the file, on any file system that Spark reads; else FileNotFoundError names all."""
    jvm = spark.sparkContext._jvm
    for folder in candidates:
        path = jvm.org.apache.hadoop.fs.Path(folder, file)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return folder
    raise FileNotFoundError(f"no folder has {file}: {', '.join(candidates)}")


def append_progress(df: DataFrame, path: str) -> None:
    """Finished results, with errors left out: they will be tried again."""
    df.where("error IS NULL").withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_progress(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The last stored result of each key."""
    rows = spark.read.parquet(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "stored_at"))), "stored_at").alias("r")).select(key, "r.*")
