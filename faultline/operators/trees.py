"""Trees of source texts as intervals.

Every opening bracket in code is a node. Depth is a running sum over brackets, by
segments, so a file of any length spreads over tasks; a node's end is the next closing
bracket of its depth. A node is below another if it begins within it, so what lies below
chosen nodes, or holds some, is told by running sums over the file: no loop over levels,
and no limit to them.

Nodes: file, pre and post (places of the brackets among the file's), depth (from 1), kind
(the bracket), head (code before it on its line), and where both brackets are: line and
column, from 0; begin is the column of the head. Brackets are matched by depth, whatever their kind; one that nothing
closes has a null post and reaches to the file's end; one that closes nothing is no node. Tables between steps are checkpointed, as each step reads its
input twice: for the sums of segments, and to carry them back. A checkpoint keeps the
size that was guessed for the texts, not that of their many nodes, so joins are merged
by hint: nothing is broadcast that grows with the nodes or the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.lexing import code_lines
from faultline.operators.segments import running
from faultline.plans.storage import checkpointed

#: Brackets, or events, of a segment.
SIZE = 4096


def brackets(lines: DataFrame, pairs: str = "{}()[]") -> DataFrame:
    """file, at (its place among the file's brackets, from 0), step (1 opens, -1 closes), kind, n, col, begin and head; lines: file, n, code."""
    sign = rf"[{''.join(chr(92) + c for c in pairs)}]"
    # What comes before each bracket ends where it does.
    before = F.regexp_extract_all("code", F.lit(rf"([^{sign[1:-1]}]*{sign})"), F.lit(1))
    ends = F.aggregate(before, F.array().cast("array<int>"), lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(x)))
    rows = lines.select("file", "n", "code", F.posexplode(ends).alias("i", "end")).withColumn("kind", F.substring("code", F.col("end"), F.lit(1)))
    opens = F.col("kind").isin(*pairs[::2])
    rows = rows.select("file", (F.col("n").cast("long") * (1 << 20) + F.col("i")).alias("place"), F.when(opens, 1).otherwise(-1).alias("step"), "kind", "n", (F.col("end") - 1).alias("col"), F.substring("code", F.lit(1), F.col("end") - 1).alias("_before"))
    rows = rows.withColumns({"head": F.trim("_before"), "begin": F.length("_before") - F.length(F.ltrim("_before"))}).drop("_before")
    # A segment has the brackets of so many lines.
    rows = checkpointed(rows.withColumn("segment", F.floor(F.col("n") / SIZE).cast("long")))
    return running(rows, F.lit(1), "at", "file", "place").withColumn("at", F.col("at") - 1).drop("place", "segment")


def nodes(files: DataFrame, pairs: str = "{}()[]") -> DataFrame:
    """The nodes of files (file, content)."""
    from faultline.sources.readers import numbered_lines

    # A small table of texts may lie in one split, though its lines and brackets are many.
    dealt = files.select("file", "content").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return of_brackets(brackets(code_lines(numbered_lines(dealt, "file", "content")), pairs))


def of_brackets(found: DataFrame) -> DataFrame:
    rows = checkpointed(found.withColumn("segment", F.floor(F.col("at") / SIZE).cast("long")))
    rows = running(rows, F.col("step"), "_sum", "file", "at").withColumn("depth", F.when(F.col("step") == 1, F.col("_sum")).otherwise(F.col("_sum") + 1))
    # On one depth brackets open and close by turns.
    turns = Window.partitionBy("file", "depth").orderBy("at")
    closed = F.when(F.lead("step").over(turns) == -1, F.lead(F.struct(F.col("at").alias("post"), F.col("n").alias("end_line"), F.col("col").alias("end_col"))).over(turns))
    out = rows.withColumn("_c", closed).where("step = 1")
    return checkpointed(out.select("file", F.col("at").alias("pre"), F.col("_c.post").alias("post"), F.col("depth").cast("int").alias("depth"), "kind", "head", F.col("n").alias("line"), "begin", "col", "_c.end_line", "_c.end_col"))


def with_parents(tree: DataFrame) -> DataFrame:
    """tree with parent, the pre of the node right above, null at the top: the last one a depth above that began before."""
    own = tree.select("file", F.col("depth").alias("_level"), "pre", F.lit(True).alias("_up"))
    asked = tree.select("file", (F.col("depth") - 1).alias("_level"), "pre", F.lit(False).alias("_up"))
    last = Window.partitionBy("file", "_level").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    found = own.unionByName(asked).withColumn("parent", F.last(F.when(F.col("_up"), F.col("pre")), ignorenulls=True).over(last)).where("NOT _up")
    return tree.join(found.select("file", "pre", "parent").hint("merge"), ["file", "pre"])


def _counted(tree: DataFrame, chosen: Column) -> DataFrame:
    """tree with _before, the chosen nodes that began before each, _open, those of them that haven't ended, and _inside, those that begin within it."""
    hit = F.coalesce(chosen, F.lit(False)).cast("int")
    rows = tree.withColumn("_hit", hit)
    begin = rows.select("file", F.col("pre").alias("at"), F.col("_hit").alias("_n"), F.col("_hit").alias("_o"), F.lit(True).alias("_begin"), "pre")
    end = rows.where("post IS NOT NULL").select("file", F.col("post").alias("at"), F.lit(0).alias("_n"), (-F.col("_hit")).alias("_o"), F.lit(False).alias("_begin"), "pre")
    events = begin.unionByName(end).withColumn("segment", F.floor(F.col("at") / SIZE).cast("long"))
    events = running(checkpointed(running(events, F.col("_n"), "_began", "file", "at")), F.col("_o"), "_still", "file", "at")
    one = lambda c, begin: F.max(F.when(F.col("_begin") == begin, F.col(c)))
    sums = events.groupBy("file", "pre").agg(one("_began", True).alias("_began"), one("_still", True).alias("_still"), one("_began", False).alias("_ended"), one("_n", True).alias("_own"))
    total = sums.groupBy("file").agg(F.max("_began").alias("_total"))
    sums = sums.join(total.hint("merge"), "file").select("file", "pre", (F.col("_still") - F.col("_own")).alias("_open"), (F.coalesce("_ended", "_total") - F.col("_began")).alias("_inside"))
    return tree.join(sums.hint("merge"), ["file", "pre"])


def below(tree: DataFrame, chosen: Column) -> DataFrame:
    """The nodes that lie in a chosen one."""
    return _counted(tree, chosen).where("_open > 0").select(*tree.columns)


def above(tree: DataFrame, chosen: Column) -> DataFrame:
    """The nodes in which a chosen one lies."""
    return _counted(tree, chosen).where("_inside > 0").select(*tree.columns)


def delete(tree: DataFrame, chosen: Column) -> DataFrame:
    """tree without the chosen nodes and what lies in them."""
    kept = ~F.coalesce(chosen, F.lit(False))
    return _counted(tree, chosen).where(kept & (F.col("_open") == 0)).select(*tree.columns)
