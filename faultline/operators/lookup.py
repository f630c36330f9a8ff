"""Lookups in tiers, memoised lookups and what isn't processed yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered(rows: DataFrame, tiers: list[tuple[DataFrame, list[str]]], value: str, required: bool = False) -> DataFrame:
    """rows with value and tier (from 1) of the first tier that has a row's key; each tier holds a key once."""
    out = rows
    for i, (tier, keys) in enumerate(tiers):
        out = out.join(tier.select(*keys, F.col(value).alias(f"_v{i}")), keys, "left")
    found = [F.col(f"_v{i}") for i in range(len(tiers))]
    at = F.coalesce(*[F.when(c.isNotNull(), i + 1) for i, c in enumerate(found)])
    hit = F.coalesce(*found, F.raise_error(F.lit("no tier has it")).cast(dict(tiers[0][0].dtypes)[value])) if required else F.coalesce(*found)
    return out.select(*rows.columns, hit.alias(value), at.alias("tier"))


def first_ranked(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key by an explicit ascending order; an aggregate, so a hot key is combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    row = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def exact_then_default(rows: DataFrame, registry: DataFrame, key: list[str], value: str) -> DataFrame:
    """rows with the value registered for their whole key, else for its last part alone, else an error.

    registry: the columns of key, the first ones null where an entry is a default, and value.
    """
    exact = registry.where(F.col(key[0]).isNotNull()).select(*[F.lower(k).alias(f"_{k}") for k in key], F.col(value).alias("_exact"))
    default = registry.where(F.col(key[0]).isNull()).select(F.lower(key[-1]).alias("_last"), F.col(value).alias("_default"))
    same = F.lit(True)
    for k in key:
        same = same & (F.lower(rows[k]) == exact[f"_{k}"])
    found = rows.join(exact, same, "left").join(default, F.lower(rows[key[-1]]) == default["_last"], "left")
    error = F.raise_error(F.concat(F.lit("nothing is registered for "), F.concat_ws("/", *[rows[k] for k in key]))).cast(dict(registry.dtypes)[value])
    return found.select(*[rows[c] for c in rows.columns], F.coalesce("_exact", "_default", error).alias(value))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key), key, "left_anti")


def memoised(rows: DataFrame, key: str, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows joined with resolve(distinct keys), so each key is resolved once."""
    return rows.join(resolve(rows.select(key).where(F.col(key).isNotNull()).distinct()), key, "left")
