"""Sinks: nested JSON, keyed results, artifacts by kind, and printed reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(*columns: str, pretty: bool = True) -> Column:
    """One JSON text of the columns; null fields are left out, times are ISO."""
    return F.to_json(F.struct(*columns), {"pretty": str(pretty).lower(), "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})


def write_json(df: DataFrame, path: str | None, mode: str = "overwrite", pretty: bool = False) -> None:
    """JSON objects, one a line, or pretty and parted by line ends; null fields are left out. Nothing is written without a path."""
    if not path:
        return
    if pretty:
        df.select(as_json(*df.columns).alias("value")).write.mode(mode).text(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").json(path)


def write_results(latest: DataFrame, path: str) -> None:
    """The whole keyed table anew; see operators.state.latest."""
    latest.write.mode("overwrite").parquet(path)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """artifacts: artifact_kind, name, content; one directory a kind."""
    artifacts.write.mode("overwrite").partitionBy("artifact_kind").parquet(path)


def printed(reports: DataFrame) -> DataFrame:
    """log_id, n and line of a readable report of each log; reports: log_id, errorsByFile."""
    files = reports.select("log_id", F.posexplode("errorsByFile").alias("f", "file"))
    heads = files.select("log_id", "f", F.lit(-1).alias("e"), F.lit(-1).alias("d"), F.format_string("%s (%d)", "file.filePath", F.size("file.errors")).alias("line"))
    errors = files.select("log_id", "f", F.posexplode("file.errors").alias("e", "error"))
    lines = errors.select("log_id", "f", "e", F.lit(-1).alias("d"), F.format_string("  line %d: %s", "error.lineNumber", "error.message").alias("line"))
    details = errors.select("log_id", "f", "e", F.posexplode("error.details").alias("d", "detail")).select("log_id", "f", "e", "d", F.concat(F.lit("    "), F.col("detail")).alias("line"))
    return heads.unionByName(lines).unionByName(details).orderBy("log_id", "f", "e", "d").select("log_id", "line")


def write_diffs(pairs: DataFrame, path: str) -> None:
    """The unified diffs of pairs (name, original, updated) as artifacts of the kind diffs."""
    from faultline.functions.python import unified_diff

    write_artifacts(pairs.select(F.lit("diffs").alias("artifact_kind"), "name", unified_diff("original", "updated").alias("content")), path)


def write_recipes(replies: DataFrame, path: str) -> None:
    """The recipe in each reply (name, reply), and the configuration that runs it, as artifacts; a reply without one is an error."""
    from faultline.functions.text import recipe, recipe_runner

    found = replies.select("name", recipe(F.col("reply")).alias("code"))
    kinds = found.select(F.lit("recipes").alias("artifact_kind"), "name", F.col("code").alias("content"))
    runs = found.select(F.lit("runs").alias("artifact_kind"), "name", recipe_runner(F.col("code")).alias("content"))
    write_artifacts(kinds.unionByName(runs), path)


def write_paged(heads: DataFrame, pages: DataFrame, path: str) -> None:
    """Heads and pages of lists (operators.pages) below path; a page is a row, whatever its list's length."""
    pages.write.mode("overwrite").parquet(f"{path}/pages")
    heads.write.mode("overwrite").parquet(f"{path}/heads")
