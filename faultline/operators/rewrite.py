"""Rewrites of trees that are tables of nodes: node_id, parent_id, node_type, name, code, arguments (array of strings), imports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.plans.storage import checkpointed


def of_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types))


def rename(nodes: DataFrame, names: Mapping[str, str], chosen: Column | None = None) -> DataFrame:
    table = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    new = F.coalesce(F.try_element_at(table, F.col("name")), F.col("name"))
    return nodes.withColumn("name", new if chosen is None else F.when(chosen, new).otherwise(F.col("name")))


def delete(nodes: DataFrame, chosen: Column, deep: bool = True) -> DataFrame:
    """nodes without the chosen ones and, if deep and parents are known, what is below them.

    Each node points to one above it and knows whether a chosen one lies up to there. A
    round doubles all distances, so a tree of n levels takes log2(n) rounds, whatever n.
    A parent that isn't among the nodes ends a path; nodes on a circle of parents are
    below the chosen ones on it. Trees with intervals need no rounds: operators.trees.
    """
    hit = F.coalesce(chosen, F.lit(False))
    if not deep or "parent_id" not in nodes.columns:
        return nodes.where(~hit)
    marks = checkpointed(nodes.select("node_id", F.col("parent_id").alias("up"), hit.alias("hit")))
    ways = marks.where("up IS NOT NULL")
    # A path that is longer than there are nodes goes in a circle.
    for _ in range(marks.count().bit_length()):
        if not ways.where("NOT hit").limit(1).count():
            break
        top = marks.select(F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("hit").alias("above"))
        marks = checkpointed(marks.join(top, "up", "left").select("node_id", F.when(~F.coalesce("above", F.lit(False)), F.col("next")).alias("up"), (F.col("hit") | F.coalesce("above", F.lit(False))).alias("hit")))
        ways = marks.where("up IS NOT NULL")
    gone = marks.where("hit").select("node_id")
    return nodes.join(gone, "node_id", "left_anti")


def find_all(files: DataFrame, pattern: str, node_type: str) -> DataFrame:
    """A node for each match of pattern in files (file, content): file, nth, node_type and code, its text."""
    found = files.select("file", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("nth", "code"))
    return found.select("file", "nth", F.lit(node_type).alias("node_type"), "code")


def visit(nodes: DataFrame, chosen: Column, key: str = "file") -> DataFrame:
    """What a read-only visitor gathers: of each key the number and the names of the chosen nodes, in the nodes' order."""
    hit = nodes.where(F.coalesce(chosen, F.lit(False)))
    return hit.groupBy(key).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("node_id", "name"))), lambda x: x["name"]).alias("names"))


def build_call(target: Column, name: Column, arguments: Column) -> Column:
    """The code of a call, or of a constructor's where the name is new and the target a type."""
    inner = F.concat(F.lit("("), F.array_join(F.coalesce(arguments, F.array().cast("array<string>")), ", "), F.lit(")"))
    return F.when(name == "new", F.concat(F.lit("new "), target, inner)).otherwise(F.concat(F.when(target.isNull(), "").otherwise(F.concat(target, F.lit("."))), name, inner))


def replace(nodes: DataFrame, chosen: Column, code: Column) -> DataFrame:
    return nodes.withColumn("code", F.when(chosen, code).otherwise(F.col("code")))


def replace_text(nodes: DataFrame, pattern: str, new: str) -> DataFrame:
    return nodes.withColumn("code", F.regexp_replace("code", pattern, new))


def add_argument(nodes: DataFrame, chosen: Column, argument: str) -> DataFrame:
    return nodes.withColumn("arguments", F.when(chosen, F.array_append("arguments", F.lit(argument))).otherwise(F.col("arguments")))


def set_argument(nodes: DataFrame, chosen: Column, at: int, argument: str) -> DataFrame:
    return nodes.withColumn("arguments", F.when(chosen, F.transform("arguments", lambda x, i: F.when(i == at, F.lit(argument)).otherwise(x))).otherwise(F.col("arguments")))


def remove_argument(nodes: DataFrame, chosen: Column, at: int) -> DataFrame:
    return nodes.withColumn("arguments", F.when(chosen, F.filter("arguments", lambda x, i: i != at)).otherwise(F.col("arguments")))


def add_import(files: DataFrame, name: str) -> DataFrame:
    return files.withColumn("imports", F.array_union("imports", F.array(F.lit(name))))


def known_type(nodes: DataFrame, default: str = "unknown") -> DataFrame:
    return nodes.withColumn("type", F.coalesce("type", F.lit(default)))
