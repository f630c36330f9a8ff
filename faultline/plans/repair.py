"""Attempts to repair many records at once, and the strategies that make them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.plans.storage import checkpointed
from faultline.schemas import ATTEMPT

#: A strategy gets the records that are still open and the attempt's number, and returns breakingCommit and the attempt's fields.
Strategy = Callable[[DataFrame, int], DataFrame]
STRATEGIES: dict[str, Strategy] = {}
ONE_ATTEMPT = f"STRUCT<{ATTEMPT}>"


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Register a strategy by its name."""

    def put(f: Strategy) -> Strategy:
        STRATEGIES[name.lower()] = f
        return f

    return put


def repaired(records: DataFrame, how: str | Strategy, most: int = 3) -> DataFrame:
    """records with attempts, in their order: each record is tried until it succeeds, ``most`` times at the most.

    A round tries all open records in one plan; what it has made is written before the next.
    """
    run = STRATEGIES[how.lower()] if isinstance(how, str) else how
    every = records.withColumn("attempts", F.array().cast(f"array<{ONE_ATTEMPT}>"))
    for n in range(1, most + 1):
        open_ = every.where(~F.exists("attempts", lambda a: F.coalesce(a["successful"], F.lit(False))))
        if not open_.limit(1).count():
            break
        made = run(open_, n).select("breakingCommit", F.struct(F.lit(n).alias("attemptCount"), "processId", "failureCategory", "logFileParent", "successful", "containerId").cast(ONE_ATTEMPT).alias("_attempt"))
        joined = every.join(made, "breakingCommit", "left")
        every = checkpointed(joined.withColumn("attempts", F.when(F.col("_attempt").isNull(), F.col("attempts")).otherwise(F.array_append("attempts", F.col("_attempt")))).select(*every.columns))
    return every
