"""Logs that are still written, as a stream: each line once, when its end is there.

The source's offset is the size of each log below a folder. A batch has the lines whose
ends came since the one before, so a line that is written in two parts comes whole with
the second, and a stream that starts anew from its checkpoint goes on where it ended. A
long stretch is cut into parts of bounded size that tasks read by themselves: a part has
the lines that end in it, from wherever they begin.

Lines are kept by batch, each batch's folder written anew if it repeats, and errors come
from the lines kept so far by operators.segments.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from faultline.functions.text import strip_trailing
from faultline.operators import segments

SCHEMA = "log_id string, n long, line string"
#: Bytes that a task reads at most, but for a line that is longer; and of those, at a time.
PART_BYTES = 32 << 20
_BLOCK = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Stretches of logs: path, and from where to before where."""

    parts: list[tuple[str, int, int]]


def _line_start(f: pa.NativeFile, at: int) -> int:
    """Where the line begins that the byte at lies in."""
    while at > 0:
        low = max(0, at - _BLOCK)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_ending(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """The lines whose ends lie from start to before end, each with where it begins."""
    at = _line_start(f, start)
    f.seek(at)
    held, place = b"", at
    while place < end:
        block = f.read(min(_BLOCK, end - place))
        if not block:
            return
        place += len(block)
        *whole, held = (held + block).split(b"\n")
        for line in whole:
            yield at, line
            at += len(line) + 1


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*.log")
        self.most = int(options.get("partbytes", PART_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        where, root = fs.FileSystem.from_uri(self.path)
        found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {x.path: x.size for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, self.glob)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        """Long stretches cut, short ones put together."""
        out, size = [Stretch([])], 0
        for path, upto in sorted(end.items()):
            for a in range(start.get(path, 0), upto, self.most):
                b = min(a + self.most, upto)
                if size and size + b - a > self.most:
                    out.append(Stretch([]))
                    size = 0
                out[-1].parts.append((path, a, b))
                size += b - a
        return out

    def read(self, partition: Stretch) -> Iterator[tuple[str, int, str]]:
        where, _ = fs.FileSystem.from_uri(self.path)
        for path, start, end in partition.parts:
            with where.open_input_file(path) as f:
                for at, line in lines_ending(f, start, end):
                    yield path, at, line.decode("utf-8", "replace")


class GrowingLogs(DataSource):
    """Format "growing_logs": options path, a URI that driver and executors reach, and glob."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def stream(spark: SparkSession, path: str, glob: str = "*.log", part_bytes: int = PART_BYTES) -> DataFrame:
    """log_id, n (where a line begins in its log, in bytes) and line."""
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("path", path).option("glob", glob).option("partbytes", str(part_bytes)).load()


def keep_lines(lines: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the stream's lines below folder, a batch a folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def kept_errors(spark: SparkSession, folder: str, segment_bytes: int = 1 << 20) -> DataFrame:
    """The errors (see buildlog.errors) of the lines kept so far, each once."""
    rows = spark.read.schema(SCHEMA).parquet(f"{folder}/batch=*")
    rows = rows.withColumn("line", strip_trailing(F.col("line")))
    return segments.errors(rows.withColumn("segment", F.floor(F.col("n") / segment_bytes).cast("long")))
