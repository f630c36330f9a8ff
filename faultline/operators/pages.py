"""Lists of any length as numbered pages beside a head row, so neither a row nor a task grows with a list.

Items are dealt by ranges of group and order, so a long list spreads over many ranges;
each range counts its items of a group, the counts of the ranges before are what an
item's rank begins from, and a page has the items of so many ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.plans.storage import checkpointed


def ranked(rows: DataFrame, group: list[str], *order: str) -> DataFrame:
    """rows with rank, from 0, in the order of their group; rows alike in order follow each other in any way, but each has a rank of its own.

    Columns of order must tell rows of a group apart where a second run is to give the same ranks.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *group, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    first = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_range", *group).orderBy(*order)
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1)
    same = numbered["_range"] == first["_range"]
    for g in group:
        same = same & numbered[g].eqNullSafe(first[g])
    return numbered.join(first, same).select(*[numbered[c] for c in rows.columns], (F.col("_first") + F.col("_own")).alias("rank"))


def paged(rows: DataFrame, group: list[str], order: list[str], size: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Heads: group, items and pages, both numbers. Pages: group, page (from 0) and items, the other columns of rows as structs in order."""
    rest = [c for c in rows.columns if c not in group]
    numbered = ranked(rows, group, *order).withColumn("page", F.floor(F.col("rank") / size).cast("long"))
    item = F.struct("rank", F.struct(*rest).alias("item"))
    ordered = F.array_sort(F.collect_list(item), lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0))
    pages = numbered.groupBy(*group, "page").agg(F.transform(ordered, lambda x: x["item"]).alias("items"))
    heads = rows.groupBy(*group).agg(F.count("*").alias("items")).withColumn("pages", F.ceil(F.col("items") / size).cast("long"))
    return heads, pages
