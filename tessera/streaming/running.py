"""Running pass rates with state variables, a first state from a table, and expiry by timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "item long, n long, c long, closed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PassRate(StatefulProcessor):
    """For each item its attempts and passes so far; with a gap, an item that had no attempt for that long by event time
    is told once more as closed and forgotten."""

    def __init__(self, gap_ms: int | None = None):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "n long, c long")
        self.seen = handle.getValueState("seen", "at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = [initialState] if isinstance(initialState, Row) else list(initialState)
        self.counts.update((sum(r.n for r in rows), sum(r.c for r in rows)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, c = self.counts.get() if self.counts.exists() else (0, 0)
        last = None
        for r in rows:
            n, c = n + 1, c + int(r.passing or 0)
            last = r.at if last is None else max(last, r.at)
        self.counts.update((n, c))
        if self.gap is not None:
            before = self.seen.get()[0] if self.seen.exists() else None
            if before is None or last > before:
                if before is not None:
                    self.handle.deleteTimer(before + self.gap)
                self.seen.update((last,))
                self.handle.registerTimer(last + self.gap)
        yield Row(item=key[0], n=n, c=c, closed=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, c = self.counts.get()
        self.counts.clear()
        self.seen.clear()
        yield Row(item=key[0], n=n, c=c, closed=True)

    def close(self) -> None:
        pass


def pass_rates(attempts: DataFrame, key: str = "user_id", gap_ms: int | None = None, late: str = "1 day", first: DataFrame | None = None) -> DataFrame:
    """A stream (item, n, c, closed), to be written in update mode, of a stream (key, ts, passing): the counts of each item
    that a batch has touched, and of those that it closed.

    `first` is a batch table (key, n, c), one row an item, to begin with; it is read by the first batch only, and after
    a restart the state in the checkpoint goes on. Rows behind the watermark take no part where items close. State
    lives in RocksDB on the executors and in the checkpoint folder, so it may outgrow memory."""
    spark = attempts.sparkSession
    use_state_store(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
    rows = attempts.select(F.col(key).cast("long").alias("item"), "ts", F.unix_millis("ts").alias("at"), F.col("passing").cast("int").alias("passing"))
    rows = rows.withWatermark("ts", late) if gap_ms is not None else rows
    begun = first.select(F.col(key).cast("long").alias("item"), F.col("n").cast("long").alias("n"), F.col("c").cast("long").alias("c")).groupBy("item") if first is not None else None
    mode = "None" if gap_ms is None else "EventTime"
    return rows.groupBy("item").transformWithState(PassRate(gap_ms), OUT, "Update", mode, begun)


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
