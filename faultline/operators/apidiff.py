"""Comparison of two API snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.pages import paged


def value_change(old: Column, new: Column) -> Column:
    return F.struct(old.alias("oldValue"), new.alias("newValue"), (~old.eqNullSafe(new)).alias("changed"))


def compare(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], keep_unchanged: bool = False) -> DataFrame:
    """A row a key: keys, changeStatus, and a change (old, new, changed) of each value.

    A full outer join on the keys: NEW, REMOVED, MODIFIED or UNCHANGED; nulls compare as equal.
    """
    a = old.select(*keys, F.struct(*values).alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "NEW").when(F.col("_b").isNull(), "REMOVED").when(~F.col("_old").eqNullSafe(F.col("_new")), "MODIFIED").otherwise("UNCHANGED")
    out = a.join(b, keys, "full_outer").select(*keys, status.alias("changeStatus"), *[value_change(F.col(f"_old.{v}"), F.col(f"_new.{v}")).alias(v) for v in values])
    return out if keep_unchanged else changed(out)


def changed(rows: DataFrame) -> DataFrame:
    """Changes only; an unchanged row stays where it is incompatible."""
    return rows.where(_kept(dict(rows.dtypes)))


def _summary() -> list[Column]:
    return [
        F.count("*").alias("totalClasses"),
        F.count_if(F.col("changeStatus") != "UNCHANGED").alias("changedClasses"),
        F.coalesce(F.sum(F.col("changedMemberCount").cast("long")), F.lit(0).cast("long")).alias("changedMembers"),
    ]


def summary(classes: DataFrame) -> DataFrame:
    """Classes, changed classes and changed members."""
    return classes.agg(*_summary())


def _kept(columns: dict[str, str]) -> Column:
    """Changes, and unchanged rows that are incompatible."""
    loose = F.lit(False)
    for c in ("binaryCompatible", "sourceCompatible"):
        if columns.get(c) == "boolean":
            loose = loose | ~F.coalesce(F.col(c), F.lit(True))
    return (F.col("changeStatus") != "UNCHANGED") | loose


def report(classes: DataFrame, old_jar: str, new_jar: str) -> DataFrame:
    """One row, a document: the jars, the time of the query, the summary, and all changed classes by name."""
    one = F.when(_kept(dict(classes.dtypes)), F.struct("fullyQualifiedName", F.struct(*classes.columns).alias("c")))
    rows = classes.agg(*_summary(), F.sort_array(F.collect_list(one)).alias("c"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    of_report = F.struct("totalClasses", "changedClasses", "changedMembers").alias("summary")
    return rows.select(F.lit(old_jar).alias("oldJar"), F.lit(new_jar).alias("newJar"), now.alias("generatedAt"), of_report, F.transform("c", lambda x: x["c"]).alias("classes"))


def report_pages(classes: DataFrame, old_jar: str, new_jar: str, size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """report() of any number of classes: a head row without them, but with how many pages they take, and the pages, classes by name."""
    kept = changed(classes).withColumn("oldJar", F.lit(old_jar)).withColumn("newJar", F.lit(new_jar))
    counts, pages = paged(kept, ["oldJar", "newJar"], ["fullyQualifiedName"], size)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    head = classes.agg(*_summary()).select(F.lit(old_jar).alias("oldJar"), F.lit(new_jar).alias("newJar"), now.alias("generatedAt"), F.struct("totalClasses", "changedClasses", "changedMembers").alias("summary"))
    none = F.lit(0).cast("long")
    return head.join(counts, ["oldJar", "newJar"], "left").withColumns({c: F.coalesce(c, none) for c in ("items", "pages")}), pages
