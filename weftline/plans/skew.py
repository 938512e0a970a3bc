"""Joins of a big table to a per-key table when some keys are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans import sizing

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000


def join_per_key(
    facts: DataFrame,
    per_key: DataFrame,
    on: list[str],
    weight: str,
    spread_by: Column,
    hot_rows: int = HOT_ROWS,
    max_broadcast: int = sizing.BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of ``facts`` with one row per key.

    Few keys (counted) are broadcast and ``facts`` stay where they are. Else both
    sides are shuffled by key. No hash build is asked for: the per-key side grows
    with the vocabulary, and a sort can spill.

    ``weight`` is a column of ``per_key`` that holds the number of fact rows of
    the key. Keys above the limit are salted: their facts are spread by the hash
    of ``spread_by``, their per-key row is repeated once per salt. The limit is
    never below total / MAX_HOT_KEYS, so at most MAX_HOT_KEYS keys are hot and
    the table of hot keys is safe to broadcast.
    """
    if sizing.fits(per_key, max_broadcast):
        return facts.join(F.broadcast(per_key), on)
    total, heaviest = per_key.agg(F.sum(weight), F.max(weight)).first()
    limit = max(hot_rows, -(-(total or 0) // MAX_HOT_KEYS))
    if (heaviest or 0) <= limit:
        return facts.join(per_key, on)
    salts = F.ceil(F.col(weight) / F.lit(limit)).cast("int")
    hot = F.broadcast(
        per_key.where(F.col(weight) > limit).select(*on, salts.alias("salts__"))
    )
    spread = facts.join(hot, on, "left").withColumn(
        "salt__",
        F.when(F.col("salts__").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(spread_by), F.col("salts__")).cast("int")
        ),
    )
    repeated = per_key.withColumn(
        "salt__",
        F.explode(
            F.when(
                F.col(weight) > limit, F.sequence(F.lit(0), salts - F.lit(1))
            ).otherwise(F.array(F.lit(0)))
        ),
    )
    return spread.join(repeated, [*on, "salt__"]).drop("salt__", "salts__")
