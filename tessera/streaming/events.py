"""Streaming extensions over event files: windows with watermarks, sessions, de-duplication.

These go beyond batch evaluation: results that are appended while a run goes on can be followed by the same
aggregations. All of them work on batch tables too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, files_at_once: int = 1, glob: str = "*.parquet", schema: StructType | None = None) -> DataFrame:
    """Event files as a stream; time zone free timestamps become timestamps, which watermarks need."""
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", glob).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "10 minutes", slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counts and sums of value by window (sliding with `slide`), late rows beyond the watermark left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *(by or []), "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
