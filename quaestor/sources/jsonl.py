"""JSON lines: a strict reader that names what is wrong, a lenient one that classifies, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema] + [T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    return lines.withColumn("row", F.from_json("value", loose, {"columnNameOfCorruptRecord": CORRUPT}))


def _missing(schema: T.StructType):
    need = [F.when(F.col(f"row.{f.name}").isNull(), f.name) for f in schema if not f.nullable]
    return F.array_compact(F.array(*need)) if need else F.array().cast("array<string>")


def read_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Each line that isn't blank with its fields and `problems`: `not_json`, or a code for each field that it must have."""
    p = _parsed(spark, path, schema)
    bad = F.when(F.col(f"row.{CORRUPT}").isNotNull() | F.col("row").isNull(), F.array(F.lit("not_json"))).otherwise(F.transform(_missing(schema), lambda f: F.concat(F.lit("missing:"), f)))
    return p.select("file", "value", bad.alias("problems"), *(F.col(f"row.{f.name}").alias(f.name) for f in schema))


def read_strict(spark: SparkSession, path: str, schema: T.StructType, key: str | None = None, number_lines: bool = True) -> DataFrame:
    """The rows of a file of which every line must be right and, with a key, unique; raises ValueError naming the first faults.

    Line numbers are looked up for faults only, so a good file is read without them.
    """
    rows = read_lenient(spark, path, schema)
    wrong = [(r.file, r.value, r.problems) for r in rows.where(F.size("problems") > 0).select("file", "value", "problems").limit(5).collect()]
    if wrong:
        where = _line_numbers(spark, path, {v for _, v, _ in wrong}) if number_lines else {}
        raise ValueError("; ".join(f"{f}:{where.get(v, '?')}: {', '.join(p)}" for f, v, p in wrong))
    if key:
        twice = [r[0] for r in rows.groupBy(key).count().where("count > 1").select(key).limit(5).collect()]
        if twice:
            raise ValueError(f"{key} isn't unique: {', '.join(map(str, twice))}")
    return rows.select(*schema.names)


def _line_numbers(spark: SparkSession, path: str, values: set[str]) -> dict[str, int]:
    """Numbers (from 1) of given lines; an RDD's index is the one thing that follows a file's order."""
    found = spark.read.text(path).rdd.zipWithIndex().filter(lambda x: x[0].value in values)
    return {row.value: i + 1 for row, i in found.take(5)}


def write_new(df: DataFrame, path: str) -> None:
    """JSON lines to a folder that must not exist."""
    df.write.mode("errorifexists").json(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections with their required fields; raises if (ticker, fiscal_year, item) isn't unique."""
    from quaestor.schemas import SECTION

    rows = read_strict(spark, path, SECTION)
    twice = rows.groupBy("ticker", "fiscal_year", "item").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"section keys aren't unique: {[tuple(r)[:3] for r in twice]}")
    return rows
