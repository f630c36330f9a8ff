"""Scans over logs of any length, cut into segments.

A log's lines lie in segments (ordered by ``segment``, and in each by ``n``), of a size
that one task can hold. Each segment is summed up by itself; the sums of a log, one row a
segment, are put together in order, and what they carry goes back to the segments. So
lines are dealt by log and segment, never by log alone, and one giant log spreads over as
many tasks as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.buildlog import END, START, WARNING, assembled, marked

#: Lines of a segment, where a table of lines has no segments yet.
LINES = 4096


def segmented(lines: DataFrame, n: str = "n", size: int = LINES) -> DataFrame:
    """lines with segment, by their numbers."""
    return lines if "segment" in lines.columns else lines.withColumn("segment", F.floor(F.col(n) / size).cast("long"))


def _back(lines: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """lines with what is carried to their segment; merged, since there may be as many segments as short files and the sizes that are guessed behind exploded rows are far too small for a broadcast."""
    return lines.join(carried.hint("merge"), [key, "segment"])


def within(lines: DataFrame, starts: Column, skipped: Column, ends: Column, key: str = "log_id", n: str = "n") -> DataFrame:
    """As buildlog.within: the lines from the first after the first start that isn't skipped, or from the top, to before the first end from there on.

    A segment's summary: its first start, and for each way of coming in (before any
    start, behind one, inside) where the range would begin and end in it.
    """
    lines = segmented(lines, n)
    own, i = Window.partitionBy(key, "segment"), F.col(n)
    first = lambda cond: F.min(F.when(cond, i)).over(own)
    seen = lines.select(key, "segment", n, starts.alias("_st"), (~skipped).alias("_ok"), ends.alias("_en"))
    seen = seen.withColumn("start", first(F.col("_st"))).withColumns({"begin": first(F.col("_ok") & (i > F.col("start"))), "begin_at_once": first(F.col("_ok")), "end": first(F.col("_en"))})
    seen = seen.withColumns({"end_behind": first(F.col("_en") & (i >= F.col("begin"))), "end_at_once": first(F.col("_en") & (i >= F.col("begin_at_once")))})
    sums = ("start", "begin", "begin_at_once", "end", "end_behind", "end_at_once")
    summary = seen.groupBy(key, "segment").agg(*[F.min(c).alias(c) for c in sums])
    log, at = Window.partitionBy(key), F.col("segment")
    place = lambda c: F.when(F.col(c).isNotNull(), F.struct("segment", F.col(c).alias("n")))
    found = summary.withColumn("_s", F.min(F.when(F.col("start").isNotNull(), at)).over(log))
    begin = F.when(at == F.col("_s"), place("begin")).when(at > F.col("_s"), place("begin_at_once"))
    found = found.withColumn("_from", F.min(begin).over(log))
    inside = F.when(at == F.col("_s"), place("end_behind")).otherwise(place("end_at_once"))
    end = F.when(F.col("_s").isNull(), place("end")).when(at == F.col("_from.segment"), inside).when(at > F.col("_from.segment"), place("end"))
    carried = found.withColumn("_to", F.min(end).over(log)).select(key, "segment", F.col("_s").isNull().alias("_top"), "_from", "_to")
    here = F.struct("segment", F.col(n).alias("n"))
    kept = (F.col("_top") | (here >= F.col("_from"))) & (F.col("_to").isNull() | (here < F.col("_to")))
    return _back(lines, carried, key).where(kept).drop("_top", "_from", "_to")


def running(rows: DataFrame, value: Column, name: str, key: str, n: str) -> DataFrame:
    """rows (with segment) with the sum of value up to each, over the whole of its key in the order of segment and n."""
    order = Window.partitionBy(key, "segment").orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(key, "segment").agg(F.sum(value).alias("_c"))
    carried = sums.select(key, "segment", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return _back(rows.withColumn("_own", F.sum(value).over(order)), carried, key).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own")


def islands(rows: DataFrame, opens: Column, key: str = "log_id", n: str = "n", record: str = "record") -> DataFrame:
    """As buildlog.islands: rows numbered by the record that they belong to; a record may go on over many segments."""
    return running(rows, F.coalesce(opens, F.lit(False)).cast("int"), record, key, n).where(F.col(record) > 0)


def errors(lines: DataFrame) -> DataFrame:
    """As buildlog.errors, of logs of any length: lines (log_id, segment, n, line), or without segment, which n gives then."""
    line = F.col("line")
    kept = within(lines, F.contains(line, F.lit(START)), line.startswith(WARNING), line.startswith(END))
    return assembled(islands(marked(kept), F.col("_header"), record="seq"))
