"""Tables in the cluster's shared folder, and batches of bounded size."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.storage import shared

_LIVE: list[Workspace] = []


class Workspace:
    """Written tables that cut lineage: a lost executor costs a reread, not a recomputation.

    They belong to whoever opened the workspace, and go with its release(), at the end
    of its with block, or at the end of the driver; nobody else drops them. Operators
    open one for what they need meanwhile, and keep what their results read in another,
    which callers may hand over to release it themselves.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared(spark)}/faultline/{name}-{uuid.uuid4().hex[:12]}"
        _LIVE.append(self)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        with contextlib.suppress(OSError):
            where, path = fs.FileSystem.from_uri(f"{self.path}/{name}")
            where.delete_dir(path)

    def release(self) -> None:
        with contextlib.suppress(OSError, ValueError):
            where, path = fs.FileSystem.from_uri(self.path)
            where.delete_dir(path)
        with contextlib.suppress(ValueError):
            _LIVE.remove(self)


def _release_all() -> None:
    for x in list(_LIVE):
        x.release()


atexit.register(_release_all)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def nested(docs: DataFrame) -> DataFrame:
    """One column, row, with all of docs' columns as fields, so that no helper's name meets one of theirs."""
    return docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"))


def flattened(rows: DataFrame, *made: str) -> DataFrame:
    """The fields of row and the columns made; a field whose name one of these has, in any case, is replaced."""
    taken = {m.lower() for m in made}
    fields = [f.name for f in rows.schema["row"].dataType.fields if f.name.lower() not in taken]
    return rows.select(*[F.col("row")[f].alias(f) for f in fields], *made)


def located(docs: DataFrame, space: Workspace) -> DataFrame:
    """row (see nested), and file and at, which no two rows share and every reading gives alike.

    They are a hash of the Parquet file's path and the row's place in it, whatever the
    rows hold. Of 10^6 files two have equal hashes with a chance of 3 in 10^8. What
    isn't read from Parquet as it stands, or by expressions that may differ from one reading
    to the next, is written to space first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    steps = plan.toString().strip().split("\n")
    plain = plan.deterministic() and all(x.lstrip("+-: ").startswith(("Project ", "Filter ", "Relation ")) for x in steps) and steps[-1].endswith("] parquet")
    rows = docs if plain else space.keep(nested(docs), "located")
    source = rows.metadataColumn("_metadata")
    row = F.struct(*[rows[quoted(c)] for c in rows.columns]).alias("row") if plain else rows["row"]
    return rows.select(row, F.xxhash64(source["file_path"]).alias("file"), source["row_index"].alias("at"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column, or a field of the column row as "row.name"."""
    outer, _, inner = name.partition(".")
    return batch.column(outer).field(inner) if inner else batch.column(outer)


def sliced(batches: Iterator[pa.RecordBatch], name: str, most: int = 1 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most whose texts take at most so many bytes, or hold one row; nothing is copied."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(column(batch, name)), 0).to_pylist()
        at = total = 0
        for i, n in enumerate(sizes):
            if i > at and (total + n > most or i - at >= rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def with_text(docs: DataFrame) -> DataFrame:
    """row (see nested) whose field text is a string."""
    return nested(docs if dict(docs.dtypes)["text"] == "string" else docs.withColumn("text", F.col("text").cast("string")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
