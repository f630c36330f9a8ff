"""Which artifact of a classpath a type comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import origin

#: Packages of the platform.
PLATFORM = ("java", "javax", "jdk", "sun", "com.sun")


def prefixes(name: Column) -> Column:
    """A name and all that it begins with up to a dot, the longest first."""
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def longest_prefix(names: DataFrame, index: DataFrame, order: str, name: str = "name") -> DataFrame:
    """name and the row of index (prefix and more) with the longest prefix of it; of equal ones the first by order, of those any one row by its values.

    Each distinct name asks for each of its prefixes by equality, so no two sides are
    compared row by row, and a prefix that many names share is met once a name.
    """
    one = index.groupBy("prefix").agg(F.min_by(F.struct(*index.columns), F.struct(order, *[c for c in index.columns if c != order])).alias("_row"))
    asked = names.select(name).where(F.col(name).isNotNull()).distinct().select(name, F.explode(prefixes(F.col(name))).alias("prefix"))
    met = asked.join(one, "prefix").groupBy(name).agg(F.max_by("_row", F.length("prefix")).alias("_row"))
    return met.select(name, "_row.*")


def owner(fqn: Column, member: Column) -> Column:
    """The type that a construct names, by its own or its member's qualified name."""
    return F.coalesce(fqn, F.regexp_extract(member, r"^(.*)\.[^.]+$", 1))


def with_dependencies(constructs: DataFrame, artifacts: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """constructs with dependency, where each one's type comes from.

    artifacts: package, position (in the classpath), path, groupId, artifactId, version; a
    type belongs to the artifact with the longest package that it lies in, of several the
    first in the classpath. own: fullyQualifiedName and sourcePath of the project's types.
    Types of the platform are the JDK's; what isn't found is unknown.
    """
    rows = constructs.withColumn("_type", owner(F.col("fullyQualifiedName"), F.col("memberQualifiedName")))
    found = longest_prefix(rows, artifacts.withColumnRenamed("package", "prefix"), "position", "_type")
    out = rows.join(found, "_type", "left")
    if own is None:
        out = out.withColumn("_source", F.lit(None).cast("string"))
    else:
        sources = own.groupBy(F.col("fullyQualifiedName").alias("_type")).agg(F.min("sourcePath").alias("_source"))
        out = out.join(sources, "_type", "left")
    platform = F.lit(False)
    for p in PLATFORM:
        platform = platform | F.col("_type").startswith(f"{p}.")
    platform = F.coalesce(platform, F.lit(False)) & F.col("prefix").isNull()
    coordinates = F.when(F.col("groupId").isNotNull(), F.concat_ws(":", "groupId", "artifactId"))
    kind = origin(F.col("_source").isNotNull(), F.col("_type").isNotNull() & (F.col("prefix").isNotNull() | platform), F.when(platform, "java.base"), F.col("path"), F.lit(None).cast("boolean"), coordinates)
    dependency = F.struct(kind.alias("origin"), F.col("groupId").alias("groupId"), F.col("artifactId").alias("artifactId"), F.col("version").alias("version"), F.coalesce("_source", "path").alias("sourcePath"))
    return out.select(*constructs.columns, dependency.alias("dependency"))
