"""Numbering and carry-forward over an order, without one big window partition.

A window over a hot group, or over the whole table, is one task. Here the order
column is cut into buckets of roughly equal row counts. A window then runs inside
each (group, bucket); a small table with one row per (group, bucket) carries the
totals from bucket to bucket.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 4096


def order_edges(
    df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> list[float]:
    """Inner bucket edges of a numeric order column; at most ``MAX_BUCKETS - 1``.

    Empty for a table that fits one bucket. Only the order column is read.
    """
    n_buckets = min(MAX_BUCKETS, -(-df.count() // rows_per_bucket))
    if n_buckets < 2:
        return []
    shares = [i / n_buckets for i in range(1, n_buckets)]
    found = df.agg(
        F.percentile_approx(F.col(column).cast("double"), shares, 10 * MAX_BUCKETS)
    ).first()[0]
    return sorted(set(found or []))


def with_bucket(df: DataFrame, column: str, edges: list[float], name: str) -> DataFrame:
    """Add the bucket of ``column``. Cast to double keeps the order, which is
    all a bucket needs: equal values always share one."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    key = f"{name}__key"
    splits = [float("-inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=key, outputCol=name)
    keyed = df.withColumn(key, F.col(column).cast("double"))
    return cut.transform(keyed).drop(key).withColumn(name, F.col(name).cast("int"))


def number_rows(
    df: DataFrame,
    group: str,
    order: list[str],
    edges: list[float],
    name: str,
) -> DataFrame:
    """1-based position of each row in its group; ``order[0]`` is the column the
    edges were taken from."""
    if not edges:
        within = Window.partitionBy(group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(within).cast("bigint"))
    bucketed = with_bucket(df, order[0], edges, "bucket__")
    earlier = (
        Window.partitionBy(group)
        .orderBy("bucket__")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(group, "bucket__")
        .agg(F.count(F.lit(1)).alias("n__"))
        .withColumn("offset__", F.coalesce(F.sum("n__").over(earlier), F.lit(0)))
        .drop("n__")
    )
    within = Window.partitionBy(group, "bucket__").orderBy(*order)
    return (
        bucketed.withColumn(name, F.row_number().over(within))
        .join(offsets, [group, "bucket__"])
        .withColumn(name, F.col(name) + F.col("offset__"))
        .drop("bucket__", "offset__")
    )


def carry_forward(
    df: DataFrame, order: str, value: Column, edges: list[float], name: str
) -> DataFrame:
    """Last non-null ``value`` of all rows before each row, over the whole table."""
    valued = with_bucket(df, order, edges, "bucket__").withColumn("value__", value)
    earlier_rows = (
        Window.partitionBy("bucket__")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = F.last("value__", ignorenulls=True).over(earlier_rows)
    if not edges:
        return valued.withColumn(name, local).drop("bucket__", "value__")
    # At most MAX_BUCKETS rows: one window without a partition key is fine here,
    # and so is the broadcast.
    earlier_buckets = Window.orderBy("bucket__").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ends = (
        valued.groupBy("bucket__")
        .agg(F.max_by("value__", F.when(F.col("value__").isNotNull(), F.col(order))).alias("end__"))
        .withColumn("before__", F.last("end__", ignorenulls=True).over(earlier_buckets))
        .drop("end__")
    )
    return (
        valued.withColumn("local__", local)
        .join(F.broadcast(ends), "bucket__")
        .withColumn(name, F.coalesce("local__", "before__"))
        .drop("bucket__", "value__", "local__", "before__")
    )
