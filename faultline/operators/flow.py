"""Types that reach what declares none, over assignments and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.storage import checkpointed

UNKNOWN = "unknown"


def typed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node_id, type) with type filled: a declared type stays; else that of all it is given, unknown if they differ or there is none.

    edges: node_id and source, of which it gets its value (what is assigned, the method
    that is called). A round takes over what the sources know and then lets each node
    look as far again, so a chain of n nodes takes log2(n) rounds; it ends when a round
    tells nothing new, circles included. Edges to what isn't among the nodes tell nothing.
    """
    known = nodes.where("type IS NOT NULL").select("node_id", F.col("type").alias("low"), F.col("type").alias("high"))
    known = checkpointed(known.groupBy("node_id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    declared = known.select("node_id")
    # What declares its type doesn't ask further.
    ways = checkpointed(edges.where("node_id IS NOT NULL AND source IS NOT NULL AND node_id != source").select("node_id", "source").distinct().join(declared, "node_id", "left_anti"))
    before = None
    while True:
        size = known.agg(F.count("*"), F.count_if(F.col("low") != F.col("high"))).first()
        if size == before:
            break
        before = size
        told = ways.join(known.withColumnRenamed("node_id", "source"), "source").select("node_id", "low", "high")
        known = checkpointed(known.unionByName(told).groupBy("node_id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        on = ways.select(F.col("node_id").alias("source"), F.col("source").alias("_next"))
        ways = checkpointed(ways.join(on, "source").where("node_id != _next").select("node_id", F.col("_next").alias("source")).distinct())
    found = known.select("node_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("_type"))
    return nodes.join(found, "node_id", "left").withColumn("type", F.coalesce("_type", F.lit(UNKNOWN))).drop("_type")
