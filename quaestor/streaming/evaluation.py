"""Scoring answers as they arrive: an extension for streams of files, with the resume rule of batch evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, source: str, schema: T.StructType, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "id", watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Answers in Parquet files under `source`, each key once, scored and appended to `sink`; stops when all are read.

    With a watermark (column, delay) keys are forgotten after the delay, so state stays bounded; without one they are
    kept for good. A batch that is tried again overwrites its own folder, so no result is stored twice.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark([key]) if watermark else rows.dropDuplicates([key])

    def store(batch: DataFrame, number: int) -> None:
        score(batch).withColumn("batch", F.lit(number)).drop("batch").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of `value` by window and key; rows later than `late` are dropped once their window is out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
