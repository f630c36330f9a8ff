"""Version combinations of dependency upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.categories import blank, matches
from faultline.operators.pages import paged

KEY = ("dependencyGroupID", "dependencyArtifactID", "previousVersion", "newVersion")


def _complete() -> Column:
    out = F.col("updatedDependency").isNotNull()
    for part in KEY:
        out = out & ~blank(F.col(f"updatedDependency.{part}"))
    return out


def usable(records: DataFrame, category: str | None = None) -> DataFrame:
    """Records of the category, or all without one, whose dependency has all four parts of the key."""
    return (records if category is None else records.where(matches(F.col("failureCategory"), category))).where(_complete())


def combinations(records: DataFrame, category: str | None = None, with_rows: bool = False) -> DataFrame:
    """A row a combination, the most frequent first, ties by key; sets are sorted and without nulls."""
    rows = usable(records, category)
    aggregates = [
        F.count("*").cast("int").alias("count"),
        F.sort_array(F.collect_set("project")).alias("projects"),
        F.sort_array(F.collect_set("breakingCommit")).alias("breakingCommits"),
        F.sort_array(F.collect_set("failureCategory")).alias("failureCategories"),
    ]
    if with_rows:
        aggregates.append(F.collect_list(F.struct("*")).alias("records"))
    out = rows.groupBy(*[F.col(f"updatedDependency.{k}").alias(k) for k in KEY]).agg(*aggregates)
    return out.withColumn("apiDiffLines", F.lit(None).cast("int")).orderBy(F.desc("count"), *KEY)


def totals(records: DataFrame, category: str | None = None) -> DataFrame:
    """One row, in one scan: all records, those of the category, and their combinations."""
    wanted = F.lit(True) if category is None else matches(F.col("failureCategory"), category)
    key = F.struct(*[F.col(f"updatedDependency.{k}").alias(k) for k in KEY])
    return records.agg(
        F.count("*").alias("totalRecords"),
        F.count_if(wanted).alias("filteredRecords"),
        F.count_distinct(F.when(wanted & _complete(), key)).alias("uniqueCombinations"),
    )


def combination_pages(records: DataFrame, category: str | None = None, size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """combinations() with all records, of any number: heads (the key and count, how many items and pages each list has) and pages of lists.

    Lists are projects, breakingCommits and failureCategories, distinct, sorted and
    without nulls, and records, whole and in the order of their commits; a page has the
    key, list, page and items, each a value, and in records the record too.
    """
    key = [F.col(f"updatedDependency.{k}").alias(k) for k in KEY]
    rows = usable(records, category).select(*key, F.struct(*records.columns).alias("record"))
    none = F.lit(None).cast(rows.schema["record"].dataType)
    lists = [rows.select(*KEY, F.lit(name).alias("list"), F.col("record")[field].alias("value"), none.alias("record")).where("value IS NOT NULL").distinct() for name, field in (("projects", "project"), ("breakingCommits", "breakingCommit"), ("failureCategories", "failureCategory"))]
    whole = rows.select(*KEY, F.lit("records").alias("list"), F.col("record.breakingCommit").alias("value"), "record")
    items = lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(whole)
    heads, pages = paged(items, [*KEY, "list"], ["value"], size)
    counts = rows.groupBy(*KEY).agg(F.count("*").alias("count"))
    return counts.join(heads, [*KEY]), pages
