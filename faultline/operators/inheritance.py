"""What types inherit, and comparison of two APIs by what their types have, wherever it is declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.apidiff import compare
from faultline.plans.storage import checkpointed


def ancestors(supers: DataFrame) -> DataFrame:
    """type, ancestor and distance, the fewest steps, of each pair that supers (type, super) lead to.

    A round joins ways with ways, so distances double, and a hierarchy of n levels takes
    log2(n) rounds. On a circle of supertypes each has the others as ancestors, never itself.
    """
    ways = supers.where("type IS NOT NULL AND super IS NOT NULL AND type != super").select("type", F.col("super").alias("ancestor"), F.lit(1).alias("distance")).distinct()
    ways, before = checkpointed(ways), None
    while True:
        size = ways.agg(F.count("*"), F.coalesce(F.sum("distance"), F.lit(0))).first()
        if size == before:
            return ways
        before = size
        on = ways.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("_top"), F.col("distance").alias("_more"))
        further = ways.join(on, "ancestor").where("type != _top").select("type", F.col("_top").alias("ancestor"), (F.col("distance") + F.col("_more")).alias("distance"))
        ways = checkpointed(ways.unionByName(further).groupBy("type", "ancestor").agg(F.min("distance").alias("distance")))


def effective(members: DataFrame, supers: DataFrame, key: list[str], inherited: Column | None = None) -> DataFrame:
    """members (type, key and more) of each type with declaredIn: its own, and what it inherits and doesn't override.

    Of members with one key that of the nearest type counts; of types as near as that, the
    first by name. inherited: which members are (all but constructors and private ones, say).
    A type that only supers name has what it inherits.
    """
    rest = [c for c in members.columns if c not in ("type", *key)]
    own = members.select("type", *key, F.struct(F.lit(0).alias("distance"), F.col("type").alias("declaredIn"), *rest).alias("_m"))
    passed = members if inherited is None else members.where(F.coalesce(inherited, F.lit(False)))
    passed = passed.withColumnRenamed("type", "ancestor").join(ancestors(supers), "ancestor")
    got = passed.select("type", *key, F.struct("distance", F.col("ancestor").alias("declaredIn"), *rest).alias("_m"))
    near = F.min_by("_m", F.struct("_m.distance", "_m.declaredIn")).alias("_m")
    return own.unionByName(got).groupBy("type", *key).agg(near).select("type", *key, "_m.declaredIn", *[F.col("_m")[c].alias(c) for c in rest])


def compare_effective(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], key: list[str], values: list[str], inherited: Column | None = None) -> DataFrame:
    """As apidiff.compare, of the effective members of two snapshots (members, supers): what moved to a supertype isn't removed.

    moved: the old and the new type that declares a member; its being another doesn't make a member changed.
    """
    a, b = (effective(*x, key, inherited) for x in (old, new))
    rows = compare(a, b, ["type", *key], [*values, "declaredIn"], keep_unchanged=True)
    same = ~F.col(values[0])["changed"] if values else F.lit(True)
    for v in values[1:]:
        same = same & ~F.col(v)["changed"]
    status = F.when((F.col("changeStatus") == "MODIFIED") & same, "UNCHANGED").otherwise(F.col("changeStatus"))
    rows = rows.withColumn("changeStatus", status).withColumnRenamed("declaredIn", "moved")
    return rows.where((F.col("changeStatus") != "UNCHANGED") | F.col("moved.changed"))
