"""Keyed results and attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that comes last; an aggregate, so partial results meet, not all of a key's rows."""
    row = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def upsert(held: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    return latest(held.unionByName(new), key, *order)


def merged_attempts(before: Column, now: Column) -> Column:
    """Both lists, one after the other; a null list is empty."""
    none = F.filter(F.coalesce(before, now), lambda x: F.lit(False))
    return F.concat(F.coalesce(before, none), F.coalesce(now, none))


def final_category(attempts: Column, otherwise: Column) -> Column:
    """That of the last attempt, if there is one."""
    return F.coalesce(F.try_element_at(attempts, F.lit(-1))["failureCategory"], otherwise)


def succeeded(attempts: Column) -> Column:
    return F.coalesce(F.exists(attempts, lambda a: F.coalesce(a["successful"], F.lit(False))), F.lit(False))


def progress(outcomes: DataFrame) -> DataFrame:
    """completed, succeeded and failed; outcomes: successful."""
    return outcomes.agg(F.count("*").alias("completed"), F.count_if(F.col("successful")).alias("succeeded"), F.count_if(~F.coalesce(F.col("successful"), F.lit(False))).alias("failed"))


def validated(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be run, and the rejected ones with a reason."""
    from faultline.functions.categories import blank

    reason = F.when(blank(F.col("breakingCommit")), "no commit").when(blank(F.col("breakingUpdateReproductionCommand")), "no command")
    marked = records.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")
