"""Late data in append mode: what comes behind the watermark is left out, and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Drained:
    """What a run over a stream did: rows taken in, rows dropped behind the watermark, and the watermark it ended with (None
    if none was set), as text in UTC."""

    rows: int
    late: int
    watermark: str | None


def accepted(events: DataFrame, late: str, key: str = "event_id") -> DataFrame:
    """Events of a stream once each, without those at or behind the watermark (the latest `ts` of earlier batches less `late`). The
    state holds keys inside the watermark only, and rows dropped here are counted one by one in the run's progress, which
    an aggregation, that sees partial sums, could not do."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def closed_windows(events: DataFrame, size: str, late: str, by: list[str] | None = None, key: str = "event_id") -> DataFrame:
    """Counts and sums of value by window over accepted events. In append mode a window comes out once, when the watermark has
    passed its end, and then never changes."""
    named = by or []
    kept = accepted(events, late, key)
    return kept.groupBy(F.window("ts", size).alias("w"), *named).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *named, "n", "total")


def drain(stream: DataFrame, path: str, progress: str) -> Drained:
    """Takes in all that is there and appends what comes out as Parquet to `path`; the next run goes on from `progress`."""
    run = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
    run.awaitTermination()
    reports = run.recentProgress
    marks = [r["eventTime"]["watermark"] for r in reports if "watermark" in (r["eventTime"] or {})]
    dropped = sum(o["numRowsDroppedByWatermark"] for r in reports for o in r["stateOperators"] if "dedupe" in o["operatorName"].lower())
    return Drained(sum(r["numInputRows"] for r in reports), dropped, marks[-1] if marks else None)
