"""Corpus variants: built aside, checked, published by one rename, described by a manifest."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import chunking

SENSITIVE = ("key", "token", "secret", "password", "credential")


def signature(value) -> str:
    """SHA-256 of a value as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def sensitive_keys(value, path: str = "") -> list[str]:
    """Paths of keys in nested data whose names hint at a secret."""
    found = []
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in items:
        here = f"{path}.{k}" if path else str(k)
        if isinstance(k, str) and any(s in k.lower() for s in SENSITIVE):
            found.append(here)
        found += sensitive_keys(v, here)
    return found


def table_digest(df: DataFrame, key: str) -> str:
    """A digest of a table's rows that doesn't hang on their order: counts and sums of hashes."""
    row = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h"), key).agg(F.count("*"), F.sum("h"), F.count_distinct(key)).first()
    return signature([int(x or 0) for x in row])


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def build_variant(sections: DataFrame, path: str, chunker: Callable[[DataFrame], DataFrame], vectors: DataFrame | None = None) -> dict:
    """Writes chunks (and vectors) beside `path`, checks them, and renames the folder to `path`, which must not exist.

    chunker: sections to chunks with chunk_id, doc_id, posicion, texto, inicio_car, fin_car. Returns the manifest, which
    lies beside the tables as JSON.
    """
    spark = sections.sparkSession
    fs, target, new_path = _filesystem(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        chunker(sections).write.parquet(f"{aside}/chunks")
        chunks = spark.read.parquet(f"{aside}/chunks")
        problems = check_variant(chunks, sections, vectors)
        if problems:
            raise ValueError("; ".join(problems))
        manifest = {"chunks": {"path": "chunks", "rows": chunks.count(), "digest": table_digest(chunks, "chunk_id")}}
        if vectors is not None:
            vectors.write.parquet(f"{aside}/vectors")
            stored = spark.read.parquet(f"{aside}/vectors")
            manifest["vectors"] = {"path": "vectors", "rows": stored.count(), "digest": table_digest(stored, "id")}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{aside}/manifest")
        if not fs.rename(new_path(aside), target):
            raise OSError(f"{path} can't be published")
    finally:
        fs.delete(new_path(aside), True)
    return manifest


def check_variant(chunks: DataFrame, sections: DataFrame, vectors: DataFrame | None = None) -> list[str]:
    """What is wrong with chunks of sections: empty, ids repeated, positions with holes, gaps, vectors without chunks."""
    n = chunks.agg(F.count("*"), F.count_distinct("chunk_id")).first()
    found = [] if n[0] else ["no chunks"]
    found += ["chunk ids aren't unique"] if n[0] != n[1] else []
    found += ["positions have holes"] if chunking.contiguity(chunks).where("NOT contiguous").limit(1).count() else []
    found += ["text between chunks is lost"] if chunking.gaps(chunks, sections.select("doc_id", "texto")).limit(1).count() else []
    if vectors is not None:
        lone = vectors.select(F.col("id").alias("chunk_id")).join(chunks, "chunk_id", "full_outer").where(F.col("texto").isNull()).limit(1).count()
        short = chunks.join(vectors.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").limit(1).count()
        found += ["vectors and chunks differ"] if lone or short else []
    return found


def check_paths(manifest: dict) -> None:
    """Raises ValueError unless each table lies in a place of its own inside the manifest's folder, by a relative path."""
    seen = {}
    for name, entry in manifest.items():
        place = posixpath.normpath(entry["path"])
        if posixpath.isabs(place) or ":" in place or place.split("/")[0] in ("..", "."):
            raise ValueError(f"{name} isn't inside the variant's folder: {entry['path']}")
        for other, taken in seen.items():
            if place == taken or place.startswith(f"{taken}/") or taken.startswith(f"{place}/"):
                raise ValueError(f"{name} and {other} share {entry['path']}")
        seen[name] = place


def open_variant(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A published variant's tables; raises if one isn't what the manifest says."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    check_paths(manifest)
    tables = {}
    for name, entry in manifest.items():
        tables[name] = spark.read.parquet(os.path.join(path, entry["path"]))
        if table_digest(tables[name], "chunk_id" if name == "chunks" else "id") != entry["digest"]:
            raise ValueError(f"{name} isn't what its manifest says")
    return tables
