"""Build logs: from lines to errors, to reports by file.

A log that lies in a row is read within it (errors_of, kept_lines); a table of lines is
read by windows, a log a task (errors, within), or by segments (operators.segments).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.categories import first_match
from faultline.functions.text import container_path, strip_leading
from faultline.operators.state import validated
from faultline.sources.readers import split_lines

#: Of a line whether something holds.
Condition = Callable[[Column], Column]

#: Where the errors of a log begin and end, and how an error's first line looks.
START = "[WARNING] For more or less details"
WARNING = "[WARNING]"
END = "[ERROR] -> [Help 1]"
HEADER = r"^\[ERROR\] (.+?):\[(\d+)(?:,(\d+))?\] (.+)$"


def within(lines: DataFrame, starts: Column, skipped: Column, ends: Column, key: str = "log_id", n: str = "n") -> DataFrame:
    """The lines from the first after the first start that isn't skipped, or from the top, to before the first end from there on."""
    log = Window.partitionBy(key)
    out = lines.withColumn("_start", F.min(F.when(starts, F.col(n))).over(log))
    after = F.min(F.when((F.col(n) > F.col("_start")) & ~skipped, F.col(n))).over(log)
    out = out.withColumn("_from", F.when(F.col("_start").isNull(), F.lit(0)).otherwise(after))
    out = out.withColumn("_to", F.min(F.when((F.col(n) >= F.col("_from")) & ends, F.col(n))).over(log))
    return out.where((F.col(n) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(n) < F.col("_to")))).drop("_start", "_from", "_to")


def islands(rows: DataFrame, opens: Column, key: str, n: str, record: str = "record") -> DataFrame:
    """rows numbered by the record that they belong to, from 1; rows before the first opening one go."""
    order = Window.partitionBy(key).orderBy(n).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(record, F.sum(F.coalesce(opens, F.lit(False)).cast("int")).over(order)).where(F.col(record) > 0)


def error_lines(lines: DataFrame) -> DataFrame:
    """lines (log_id, n, line) between a log's markers."""
    line = F.col("line")
    return within(lines, F.contains(line, F.lit(START)), line.startswith(WARNING), line.startswith(END))


def marked(lines: DataFrame) -> DataFrame:
    """lines with _header, whether an error begins there, and _rest, the detail that a line adds to one, if any."""
    line = F.col("line")
    header = line.rlike(HEADER)
    rest = strip_leading(F.substring(line, 8, 1 << 30))
    return lines.withColumn("_header", header).withColumn("_rest", F.when(~header & line.startswith("[ERROR]") & (rest != "") & ~rest.startswith("->"), rest))


def assembled(rows: DataFrame) -> DataFrame:
    """Errors of marked lines numbered by seq."""
    rows = rows.where(F.col("_header") | F.col("_rest").isNotNull())
    head = F.max(F.when(F.col("_header"), F.col("line"))).alias("head")
    details = F.transform(F.array_sort(F.collect_list(F.when(~F.col("_header"), F.struct("n", F.col("_rest").alias("text"))))), lambda x: x["text"])
    return _parsed(rows.groupBy("log_id", "seq").agg(head, details.alias("details")))


def _parsed(found: DataFrame) -> DataFrame:
    """log_id, seq, the parts of head, and details."""
    part = lambda i: F.regexp_extract("head", HEADER, i)
    number = lambda i: F.nullif(part(i), F.lit("")).try_cast("int")
    return found.select("log_id", F.col("seq").cast("int").alias("seq"), part(1).alias("filePath"), number(2).alias("lineNumber"), number(3).alias("columnNumber"), part(4).alias("message"), "details")


def errors(lines: DataFrame) -> DataFrame:
    """log_id, seq, filePath, lineNumber, columnNumber, message and details of each error; lines: log_id, n, line.

    Where logs lie in rows of their own, errors_of is cheaper; for logs of any length see segments.errors.
    """
    return assembled(islands(marked(error_lines(lines)), F.col("_header"), "log_id", "n", "seq"))


def _let(value: Column, body: Condition) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def kept_lines(lines: Column, starts: Condition, skipped: Condition, ends: Condition) -> Column:
    """within() over an array of lines: a struct of first, the place of the first line kept, and lines."""
    # The place of the first line that something holds for, from 1, or null.
    first = lambda x, holds: F.nullif(F.array_position(F.transform(x, lambda v: F.coalesce(holds(v), F.lit(False))), F.lit(True)), F.lit(0).cast("long"))
    rest = lambda begin: F.slice(lines, begin + 1, F.size(lines))
    begin = lambda start: F.when(start.isNull(), F.lit(0).cast("long")).otherwise(start + first(F.slice(lines, start + 1, F.size(lines)), lambda v: ~skipped(v)) - 1)
    upto = lambda x: F.slice(x, F.lit(1), F.coalesce(first(x, ends) - 1, F.size(x).cast("long")).cast("int"))
    kept = lambda at: F.when(at.isNotNull(), F.struct(at.cast("int").alias("first"), _let(rest(at), upto).alias("lines")))
    return _let(first(lines, starts), lambda start: _let(begin(start), kept))


def errors_of(logs: DataFrame) -> DataFrame:
    """As errors, of logs that lie in rows (log_id, content): all within the row, so nothing is shuffled."""
    cut = logs.select("log_id", split_lines(F.col("content")).alias("_all"))
    kept = cut.select("log_id", kept_lines(F.col("_all"), lambda x: F.contains(x, F.lit(START)), lambda x: x.startswith(WARNING), lambda x: x.startswith(END))["lines"].alias("_lines"))
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(HEADER), i)), lambda i: i.isNotNull())
    kept = kept.where(F.size("_lines") > 0).withColumn("_heads", heads)
    rest = lambda x: F.when(x.startswith("[ERROR]"), strip_leading(F.substring(x, 8, 1 << 30)))
    below = lambda h, k: F.slice("_lines", h + 2, F.coalesce(F.get("_heads", k + 1), F.size("_lines")) - h - 1)
    details = lambda x: F.filter(F.transform(x, rest), lambda t: (t != "") & ~t.startswith("->"))
    records = F.transform("_heads", lambda h, k: F.struct(F.get("_lines", h).alias("head"), details(below(h, k)).alias("details")))
    return _parsed(kept.select("log_id", F.posexplode(records).alias("seq", "r")).select("log_id", (F.col("seq") + 1).alias("seq"), "r.head", "r.details"))


def by_file(found: DataFrame) -> DataFrame:
    """log_id and errorsByFile; files in the order of their first error, errors in the log's order."""
    one = F.struct("seq", "lineNumber", "columnNumber", "message", "details")
    files = found.groupBy("log_id", "filePath").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(one)).alias("errors"))
    plain = F.transform("errors", lambda e: F.struct(*[e[x].alias(x) for x in ("lineNumber", "columnNumber", "message", "details")]))
    files = files.withColumn("errors", plain)
    groups = files.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("first", "filePath", "errors"))).alias("g"))
    return groups.select("log_id", F.transform("g", lambda x: F.struct(x["filePath"].alias("filePath"), x["errors"].alias("errors"))).alias("errorsByFile"))


def first_known(category: Column, order: Column, unknown: str = "UNKNOWN") -> Column:
    """An aggregate: the first category, by order, that isn't unknown."""
    return F.min_by(F.when(category != unknown, category), F.when(category != unknown, order))


def reports(logs: DataFrame) -> DataFrame:
    """originalFailurePath, failureCategory and errorsByFile of each row of logs (log_id, content).

    A null or empty content is UNKNOWN and has no errors. Each log is read once.
    """
    category = logs.select("log_id", first_match(F.col("content")).alias("failureCategory"))
    grouped = by_file(errors_of(logs))
    none = F.array().cast("array<struct<filePath:string,errors:array<struct<lineNumber:int,columnNumber:int,message:string,details:array<string>>>>>")
    return category.join(grouped, "log_id", "left").select(F.col("log_id").alias("originalFailurePath"), "failureCategory", F.coalesce("errorsByFile", none).alias("errorsByFile"))


def total_errors(files: Column) -> Column:
    return F.aggregate(F.transform(files, lambda f: F.size(f["errors"])), F.lit(0), lambda a, x: a + x)


def errors_by_file(files: Column) -> Column:
    """A map from path to errors, null if there are none; of a path that repeats the last count stays."""
    entries = F.transform(files, lambda f, i: F.struct(f["filePath"].alias("k"), i.alias("i"), F.size(f["errors"]).alias("v")))
    last = F.transform(F.array(F.array_sort(entries)), lambda e: F.filter(e, lambda x, i: ~x["k"].eqNullSafe(F.get(e, i + 1)["k"])))[0]
    ordered = F.array_sort(F.transform(last, lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), x["v"].alias("v"))))
    return F.when(F.size(files) > 0, F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))))


def wanted(logs: DataFrame, found: DataFrame) -> DataFrame:
    """log_id and content of the logs that are asked for (log_id); null where found has none, which reports() calls UNKNOWN."""
    return logs.select("log_id").join(found.select("log_id", "content"), "log_id", "left")


def processed(records: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of upgrade records and the logs found for them (project, breakingCommit, logPath, content) the result of each, and what can't be run with a reason.

    Logs without a project column are their commit's, whatever the project.
    A result has the record's project, commit and container path, the log's path, its
    category, errors in all and by file (null if none), and the time of the query.
    """
    good, bad = validated(records)
    if "project" in logs.columns:
        own = logs.select(F.coalesce("project", F.lit("")).alias("_project"), F.col("breakingCommit").alias("_commit"), "logPath", "content")
        with_log = good.join(own, (F.coalesce("project", F.lit("")) == F.col("_project")) & (F.col("breakingCommit") == F.col("_commit")), "left").drop("_project", "_commit")
    else:
        with_log = good.join(logs, "breakingCommit", "left")
    bad = bad.unionByName(with_log.where("logPath IS NULL").select(*good.columns, F.lit("no log").alias("reason")))
    found = reports(with_log.where("logPath IS NOT NULL").select(F.col("logPath").alias("log_id"), "content").dropDuplicates(["log_id"]))
    rows = with_log.where("logPath IS NOT NULL").drop("content").join(found, F.col("logPath") == F.col("originalFailurePath"))
    files = F.col("errorsByFile")
    results = rows.select("project", "breakingCommit", container_path(F.col("project")).alias("containerPath"), "logPath", rows["errorsByFile"].alias("_files"), found["failureCategory"].alias("failureCategory"), total_errors(files).alias("totalErrors"), F.current_timestamp().alias("finishedAt"))
    return results.withColumn("errorsByFile", errors_by_file(F.col("_files"))).drop("_files"), bad
