"""Attempts as they come, and what became of each when none has come for a while.

State holds the attempts of a commit that wait, as a list, and the end of the latest;
a timer fires once the watermark has passed it by the idle time. Attempts further apart
than that belong to different runs, in whatever batches they come; a run is given out
once, when no attempt that the watermark lets in can join it, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "breakingCommit string, began timestamp, ended timestamp, attempts long, categories array<string>, finalCategory string, succeeded boolean"


def with_rocksdb(spark: SparkSession) -> None:
    """State of several kinds and timers needs this store; it holds for streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Runs(StatefulProcessor):
    """Attempts (at in milliseconds, category, n) to runs; see closed_runs."""

    def __init__(self, idle_ms: int, success: str):
        self.idle, self.success = idle_ms, success

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("attempts", StructType([StructField("at", LongType()), StructField("n", LongType()), StructField("category", StringType())]))
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def _later(self, rows: list[tuple]) -> None:
        """Hold rows, and look again when the first run among them can be over."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not rows:
            self.held.clear()
            self.last.clear()
            return
        self.held.put(rows)
        self.last.update((rows[-1][0],))
        ends = [a[0] for a, b in zip(rows, rows[1:], strict=False) if b[0] - a[0] > self.idle]
        self.handle.registerTimer((ends[0] if ends else rows[-1][0]) + self.idle)

    def _rows(self) -> list[tuple]:
        return [(r[0], r[1], r[2]) for r in self.held.get()] if self.held.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._later(sorted(self._rows() + [(r["_at"], r["_n"], r["_category"]) for r in rows], key=lambda r: r[:2]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, rows, begin = timerValues.getCurrentWatermarkInMs(), self._rows(), 0
        for i, r in enumerate(rows):
            if i + 1 < len(rows) and rows[i + 1][0] - r[0] <= self.idle:
                continue
            if r[0] + self.idle > now:
                break
            yield self._shown(key[0], rows[begin : i + 1])
            begin = i + 1
        self._later(rows[begin:])

    def _shown(self, commit: str, run: list[tuple]) -> Row:
        categories = [c for _, _, c in run]
        when = lambda ms: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)
        return Row(breakingCommit=commit, began=when(run[0][0]), ended=when(run[-1][0]), attempts=len(run), categories=categories, finalCategory=categories[-1], succeeded=self.success in categories)

    def close(self) -> None:
        pass


def closed_runs(attempts: DataFrame, idle: timedelta, late: str = "10 minutes", success: str = "BUILD_SUCCESS") -> DataFrame:
    """A row of RUN for each run of attempts (breakingCommit, at, n, category) that is over: no attempt for longer than idle.

    Attempts are ordered by at, then n. Those that come later than the watermark allows are dropped by the stream.
    """
    rows = attempts.withWatermark("at", late).select(F.col("breakingCommit").cast("string").alias("breakingCommit"), F.unix_millis("at").alias("_at"), F.col("n").cast("long").alias("_n"), F.col("category").alias("_category"), "at")
    return rows.groupBy("breakingCommit").transformWithState(Runs(int(idle.total_seconds() * 1000), success), RUN, "Append", "EventTime")
