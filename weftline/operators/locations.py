"""Append-only location log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.sizing import broadcast_if_small
from weftline.sources.workspace import path_exists

DAY = "event_date"
NO_DAY = "1900-01-01"


def with_day(events: DataFrame) -> DataFrame:
    """An event without a time has a day of its own, so its repeats meet it too."""
    return events.withColumn(DAY, F.coalesce(F.to_date("ts"), F.lit(NO_DAY).cast("date")))


def new_locations(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that ``log`` does not hold, each event once.

    Both carry ``event_date``. An event keeps its time, so only the days of the
    batch are read from a log partitioned by day.
    """
    once = batch.dropDuplicates([DAY, "event_id"])
    days = broadcast_if_small(batch.select(DAY).distinct())
    held = log.join(days, DAY, "left_semi").select(DAY, "event_id")
    return once.join(held, [DAY, "event_id"], "left_anti")


def write_log(rows: DataFrame, path: str) -> None:
    """One file per day of the batch; of a day beyond Spark's advisory partition size,
    as many as it takes."""
    rows.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def location_append(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Append a batch to the log at ``path`` and return the log. Appending the
    same batch again adds nothing; the first append makes the log."""
    rows = with_day(batch)
    if path_exists(spark, path):
        log = spark.read.schema(rows.schema).parquet(path)
    else:
        log = spark.createDataFrame([], rows.schema)
    write_log(new_locations(log, rows).select(rows.columns), path)
    return spark.read.schema(rows.schema).parquet(path).drop(DAY)


def location_latest(events: DataFrame) -> DataFrame:
    """Latest event per user: user_id, event_id, ts, value. One running maximum
    per task and user; a busy user is no hot group."""
    latest = F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(latest.alias("last")).select("user_id", "last.*")
