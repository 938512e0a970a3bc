"""Size checks that come before anything is broadcast or brought to the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than needed."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow key table for broadcast after counting it.

    Beyond the bound the table is returned as it is and Spark shuffles the join.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def fetch_bounded(df: DataFrame, max_rows: int) -> pa.Table | None:
    """The rows of ``df`` as one Arrow table, or None when there are too many."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


SMALL_INPUT_PARTITIONS = 64


def spread_small_input(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of a few splits enough tasks for heavy per-row work.

    Only an input of fewer than ``SMALL_INPUT_PARTITIONS`` partitions that would
    leave cores idle is moved; a large scan has splits enough and is left alone.
    ``key`` should be unique, so the spread is even and the same on a retry.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = min(cores, SMALL_INPUT_PARTITIONS)
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, key)
