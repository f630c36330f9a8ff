"""Source lines by lexical state: what of them is code, and what is in comments, strings, characters or text blocks.

Only block comments and text blocks go on behind a line's end. So a line is a map from
the state that it is entered in to the one that it is left in. Maps compose, and the
order of composing doesn't matter: a segment's map is an aggregate over its lines, a
file's segments are composed in order, and what they carry goes back to the lines. A file
of any length is dealt by segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.segments import segmented

CODE, BLOCK, TEXT = 0, 1, 2
#: Lines of a segment.
LINES = 512
#: What may begin in code, in the order in which it is tried; each ends on its line or at its end.
_SKIPPED = r"""//.*|/\*(?s:.*?)(?:\*/|$)|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|$)|"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)"""
_TOKEN = _SKIPPED + r"""|[^/"']+|[/"']"""
_CLOSED = {BLOCK: r"^/\*(?s:.*?)\*/$", TEXT: r'^"""(?:\\.|[^\\])*?"""$'}
_ENDS = {BLOCK: r"^(?s:.*?)\*/", TEXT: r'^(?:\\.|[^\\])*?"""'}


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(f"({_TOKEN})"), F.lit(1))


def _left(line: Column) -> Column:
    """The state that a line leaves which is entered in code."""
    last = F.coalesce(F.try_element_at(_tokens(line), F.lit(-1)), F.lit(""))
    opened = lambda s, mark: last.startswith(mark) & ~last.rlike(_CLOSED[s])
    return F.when(opened(BLOCK, "/*"), BLOCK).when(opened(TEXT, '"""'), TEXT).otherwise(CODE)


def _head(line: Column, state: int) -> Column:
    """What of a line entered in a comment or a text block still belongs to that; null if all."""
    return F.nullif(F.regexp_extract(line, _ENDS[state], 0), F.lit(""))


def _rest(line: Column, head: Column) -> Column:
    return F.substring(line, F.length(head) + 1, F.length(line))


def line_map(line: Column) -> Column:
    """An array of the states that a line leaves, by the one that it is entered in."""
    leaves = [_left(line)]
    for state in (BLOCK, TEXT):
        head = _head(line, state)
        leaves.append(F.when(head.isNull(), state).otherwise(_left(_rest(line, head))))
    return F.array(*leaves)


def code_of(line: Column, state: Column) -> Column:
    """A line with spaces for all that isn't code, so columns stay."""
    skipped = lambda t: F.when(t.rlike(rf"^(?:{_SKIPPED})$"), F.repeat(F.lit(" "), F.length(t))).otherwise(t)
    plain = lambda x: F.array_join(F.transform(_tokens(x), skipped), "")
    out = F.when(state == CODE, plain(line))
    for s in (BLOCK, TEXT):
        head = F.coalesce(_head(line, s), line)
        out = F.when(state == s, F.concat(F.repeat(F.lit(" "), F.length(head)), plain(_rest(line, head)))).otherwise(out)
    return out


def _walked(maps: Column) -> Column:
    """Of an array of maps, for each state before the first: the states before each as digits, and the one behind the last."""
    begin = F.struct(*[F.lit(s).alias(f"s{s}") for s in range(3)], *[F.lit("").alias(f"d{s}") for s in range(3)])

    def step(acc: Column, m: Column) -> Column:
        now = [F.element_at(m, acc[f"s{s}"] + 1).alias(f"s{s}") for s in range(3)]
        return F.struct(*now, *[F.concat(acc[f"d{s}"], acc[f"s{s}"].cast("string")).alias(f"d{s}") for s in range(3)])

    return F.aggregate(maps, begin, step)


def _after(walked: Column) -> Column:
    return F.array(*[walked[f"s{s}"] for s in range(3)])


def states(lines: DataFrame, file: str = "file", n: str = "n", line: str = "line", size: int = LINES) -> DataFrame:
    """lines (file, n, line) with state, that in which each is entered."""
    rows = segmented(lines, n, size).withColumn("_map", line_map(F.col(line)))
    rest = [c for c in lines.columns if c not in (file, "segment")]
    held = F.array_sort(F.collect_list(F.struct(F.col(n).alias("_n"), F.col("_map"), F.struct(*rest).alias("_row"))), lambda a, b: F.when(a["_n"] < b["_n"], -1).when(a["_n"] > b["_n"], 1).otherwise(0))
    held = rows.groupBy(file, "segment").agg(held.alias("_held")).withColumn("_walked", _walked(F.transform("_held", lambda x: x["_map"])))
    whole = F.array_sort(F.collect_list(F.struct("segment", _after(F.col("_walked")).alias("_map"))))
    files = held.groupBy(file).agg(whole.alias("_all")).withColumn("_states", _walked(F.transform("_all", lambda x: x["_map"]))["d0"])
    entered = files.select(file, F.posexplode("_all").alias("_i", "_x"), "_states").select(file, F.col("_x.segment").alias("segment"), F.substring("_states", F.col("_i") + 1, F.lit(1)).alias("_state"))
    digits = F.when(F.col("_state") == "0", F.col("_walked.d0")).when(F.col("_state") == "1", F.col("_walked.d1")).otherwise(F.col("_walked.d2"))
    out = held.join(entered, [file, "segment"]).select(file, "segment", digits.alias("_digits"), F.posexplode("_held").alias("_i", "_x"))
    found = out.select(file, "segment", "_x._row.*", F.substring("_digits", F.col("_i") + 1, F.lit(1)).cast("int").alias("state"))
    return found.select(*lines.columns, "state")


def code_lines(lines: DataFrame, file: str = "file", n: str = "n", line: str = "line", size: int = LINES) -> DataFrame:
    """lines (file, n, line) with code, the line with spaces for comments and literals."""
    found = states(lines, file, n, line, size)
    return found.withColumn("code", code_of(F.col(line), F.col("state"))).drop("state")
