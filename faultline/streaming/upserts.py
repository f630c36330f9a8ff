"""Streams of results: the latest of each key, held in state or merged by batch."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType

from faultline.operators.state import latest


def each_batch(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch to consume."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(consume).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class KeyedTable:
    """The latest row of each key, in buckets by a hash of the key; a batch rewrites the buckets that it touches only.

    Each batch writes its buckets' new files, then a manifest that names the files of all
    buckets, so a reader sees whole batches and a batch that repeats gives the same
    table. Files that neither the last nor the last but one manifest names are removed.
    The manifest has a line for each bucket, however many rows there are.
    """

    def __init__(self, path: str, key: str, *order: str, buckets: int = 64):
        self.path, self.key, self.order, self.buckets = path, key, order, buckets

    def _files(self, epoch: int | None = None) -> tuple[int, dict[int, int]]:
        """The last manifest's batch, or that of the last before epoch, and the batch that wrote each bucket; -1 if there is none."""
        where, root = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        at = max((n for n in (int(x.base_name) for x in found if x.base_name.isdigit()) if epoch is None or n < epoch), default=-1)
        if at < 0:
            return at, {}
        with where.open_input_stream(f"{root}/manifests/{at}") as f:
            return at, {int(k): v for k, v in json.loads(f.read().decode()).items()}

    def _rows(self, spark: SparkSession, schema: StructType, files: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{epoch}/bucket={bucket}" for bucket, epoch in sorted(files.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        return self._rows(spark, schema, self._files()[1])

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        before, files = self._files(epoch)
        batch = latest(batch, self.key, *self.order).persist()
        try:
            touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
            held = self._rows(spark, batch.schema, {b: e for b, e in files.items() if b in touched})
            rows = latest(held.unionByName(batch), self.key, *self.order).withColumn("bucket", bucket)
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/{epoch}")
        finally:
            batch.unpersist()
        now = files | dict.fromkeys(touched, epoch)
        where, root = fs.FileSystem.from_uri(self.path)
        where.create_dir(f"{root}/manifests", recursive=True)
        with where.open_output_stream(f"{root}/manifests/.{epoch}") as f:
            f.write(json.dumps(now).encode())
        where.move(f"{root}/manifests/.{epoch}", f"{root}/manifests/{epoch}")
        gone = set(self._files(before)[1].items()) - set(files.items()) - set(now.items()) if before >= 0 else set()
        for b, e in gone:
            with contextlib.suppress(OSError):
                where.delete_dir(f"{root}/data/{e}/bucket={b}")


def upsert_into(path: str, key: str, *order: str, buckets: int = 64) -> KeyedTable:
    """A consumer for each_batch that keeps the latest row of each key below path, a URI."""
    return KeyedTable(path, key, *order, buckets=buckets)


def counted_by_window(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """window_start, event_type and n; events: ts, event_type. Later events than the watermark allows are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")


def latest_in_state(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value and order of the latest event of each key so far, whenever a batch changes it; all keep their types.

    Of events with equal order the first stays; those without an order are left out.
    """
    kinds = {c: events.schema[c].dataType for c in (key, value, order)}
    schema = StructType([StructField(c, k) for c, k in kinds.items()])
    held_as = StructType([StructField(c, kinds[c]) for c in (value, order)])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for frame in frames:
            row = frame.loc[frame[order].idxmax()] if len(frame) else None
            if row is not None and (best is None or row[order] > best[1]):
                best = (_plain(row[value]), _plain(row[order]))
        if best is not None and best != held:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], value: [best[0]], order: [best[1]]})

    rows = events.select(key, value, order).where(F.col(order).isNotNull())
    return rows.groupBy(key).applyInPandasWithState(step, schema, held_as, "update", "NoTimeout")


def _plain(x):
    """A value of a frame as the state takes it."""
    if x is None or x is pd.NaT or x != x:
        return None
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x.item() if hasattr(x, "item") else x
