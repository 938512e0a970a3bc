"""Health reports: size, distribution over layers, coverage of one column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.workspace import stage


def layer_counts(table: DataFrame, covered: str, *more: str) -> DataFrame:
    """``more``, layer, n, covered: rows, and rows in which a column is held. Counts of
    parts of a table add up to those of the table."""
    return table.groupBy(*more, "layer").agg(F.count(F.lit(1)).alias("n"), F.count(covered).alias("covered"))


def layer_report(counts: DataFrame, count_name: str, coverage_name: str) -> DataFrame:
    """layer, count, share and coverage from counts of any number of parts."""
    # Stored, so that the table is read once for the counts and for their total.
    layers = stage(counts.groupBy("layer").agg(F.sum("n").alias(count_name), F.sum("covered").alias("covered__")), "layers")
    total = layers.agg(F.sum(count_name)).scalar()
    return layers.select(
        "layer",
        count_name,
        F.round(F.col(count_name) / total, 6).alias("share"),
        F.round(F.col("covered__") / F.col(count_name), 6).alias(coverage_name),
    )


def chunk_index_health(chunks: DataFrame) -> DataFrame:
    """layer, n_chunks, share, symbol_coverage."""
    return layer_report(layer_counts(chunks, "symbol"), "n_chunks", "symbol_coverage")


def vector_index_health(points: DataFrame) -> DataFrame:
    """layer, n_points, share, summary_coverage."""
    return layer_report(layer_counts(points, "summary"), "n_points", "summary_coverage")
