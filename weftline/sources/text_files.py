"""Text files as documents, in the order the caller lists them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIONS_SCHEMA = "path string, doc_id bigint"
LOCAL = "^file:/+"  # local names come with one slash or three


def read_text_documents(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file: ``doc_id`` (position in ``paths``), ``path``, ``text``.

    All files are one scan; the list is a table joined to it by path, so a file named
    twice is two documents. Every path is a file, a folder or pattern is an error. The
    file, not the line, is the row: line order then needs no sort. A file must fit one
    string value (2 GB).
    """
    if not paths:
        raise ValueError("no input files")
    named = [(_file_name(spark, path), position) for position, path in enumerate(paths)]
    positions = spark.createDataFrame(named, POSITIONS_SCHEMA)
    files = spark.read.text(sorted(set(paths)), wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    key = F.regexp_replace("path", LOCAL, "file:/")
    held, asked = files.withColumn("key__", key), positions.select("doc_id", key.alias("key__"))
    return held.join(asked, "key__").select("doc_id", "path", "text")


def _file_name(spark: SparkSession, path: str) -> str:
    """The full name of a file as the scan reports it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.getFileStatus(place).isFile():
        raise ValueError(f"not a file: {path}")
    return system.makeQualified(place).toUri().toString()
