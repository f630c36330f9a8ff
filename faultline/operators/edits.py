"""Rewrites of source texts as edits, so what isn't rewritten stays as it is, byte for byte.

An edit replaces the characters from start to before end (code points, from 0) of a file
by new. Two edits overlap if one begins within the other; an insertion (start = end)
overlaps only what it lies strictly within. Of overlapping edits the one with the lower
rank stays, then the one that begins first, is longer, and has the smaller text; one that
overlaps only edits that went stays too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDIT = ("file", "start", "end", "new", "rank")


def resolved(edits: DataFrame) -> DataFrame:
    """The edits (file, start, end, new, rank) that stay.

    Edits that touch each other, directly or by others, make a cluster; each is looked at by itself.
    """
    order = Window.partitionBy("file").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = edits.select(*EDIT).distinct().withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    rows = rows.withColumn("_cluster", F.sum("_new").over(order))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "start", (-F.col("end")).alias("back"), "end", "new")))
    apart = lambda a, b: (a["start"] >= b["end"]) | (b["start"] >= a["end"])
    none = F.array().cast("array<struct<rank:int,start:int,back:int,end:int,new:string>>")
    clusters = rows.withColumns({c: F.col(c).cast("int") for c in ("rank", "start", "end")}).groupBy("file", "_cluster").agg(ranked.alias("_r"))
    kept = F.aggregate("_r", none, lambda acc, e: F.when(F.forall(acc, lambda k: apart(k, e)), F.array_append(acc, e)).otherwise(acc))
    return clusters.select("file", F.explode(kept).alias("e")).select("file", "e.start", "e.end", "e.new", "e.rank")


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (file, content) with the edits that stay made; insertions at one place follow each other by rank, before what begins there."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "rank", "new")))
    by_file = resolved(edits).groupBy("file").agg(ordered.alias("_edits"))
    rows = files.join(by_file.hint("merge"), "file", "left")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content, found in zip(batch.column("content").to_pylist(), batch.column("_edits").to_pylist(), strict=True):
                if content is not None and found:
                    parts, at = [], 0
                    for e in found:
                        parts += [content[at : e["start"]], e["new"] or ""]
                        at = e["end"]
                    content = "".join([*parts, content[at:]])
                out.append(content)
            at = batch.schema.get_field_index("content")
            yield batch.set_column(at, "content", pa.array(out, pa.string())).drop_columns(["_edits"])

    return rows.mapInArrow(of, rows.drop("_edits").schema)


def of_pattern(files: DataFrame, pattern: str, new: str, rank: int = 0, group: int = 0) -> DataFrame:
    """An edit for each match of a pattern in files (file, content), of one of its groups; new may name groups as re.sub does."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(pattern)
        for batch in batches:
            names, start, end, texts = [], [], [], []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for m in found.finditer(content or ""):
                    if m.start(group) >= 0:
                        names.append(file)
                        start.append(m.start(group))
                        end.append(m.end(group))
                        texts.append(m.expand(new))
            ranks = pa.array([rank] * len(names), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field("file").type), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(texts, pa.string()), ranks], names=list(EDIT))

    kind = dict(files.dtypes)["file"]
    return files.select("file", "content").mapInArrow(of, f"file {kind}, start int, end int, new string, rank int")


def _starts(files: DataFrame) -> DataFrame:
    """file and, by line, the offset at which it begins."""
    lines = F.regexp_extract_all("content", F.lit(r"([^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$)"), F.lit(1))
    sizes = F.transform(lines, F.length)
    begin = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    return files.select("file", F.posexplode(begin).alias("n", "offset"))


def of_places(files: DataFrame, places: DataFrame) -> DataFrame:
    """Edits whose start and end are given by line and column: places has file, line, col, end_line, end_col, new and rank."""
    starts = _starts(files)
    first = starts.select("file", F.col("n").alias("line"), F.col("offset").alias("_a"))
    last = starts.select("file", F.col("n").alias("end_line"), F.col("offset").alias("_b"))
    # Lines are many more than the size guessed for their files says, so they are merged, not broadcast.
    found = places.join(first.hint("merge"), ["file", "line"]).join(last.hint("merge"), ["file", "end_line"])
    return found.select("file", (F.col("_a") + F.col("col")).alias("start"), (F.col("_b") + F.col("end_col")).alias("end"), "new", "rank")


def deletions(tree: DataFrame, chosen: Column, rank: int = 0, head: bool = True) -> DataFrame:
    """Places (see of_places) of chosen nodes of a tree (operators.trees), from what heads them on their line, if asked for, to their last bracket."""
    begin = F.col("begin" if head else "col")
    return tree.where(F.coalesce(chosen, F.lit(False)) & F.col("post").isNotNull()).select("file", "line", begin.alias("col"), "end_line", (F.col("end_col") + 1).alias("end_col"), F.lit("").alias("new"), F.lit(rank).alias("rank"))
