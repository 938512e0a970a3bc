"""Published versions of tables.

A version is written to a path of its own. Publishing appends one small file to
a ledger; the row with the highest number for a name is what readers see. No
file is ever overwritten, so a reader keeps a consistent table and a failed
build changes nothing. One writer per store at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.workspace import path_exists

LEDGER_SCHEMA = "seq bigint, name string, path string, schema string"
LEDGER_NAMES = ["seq", "name", "path", "schema"]
LEDGER_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string()]


@dataclass(frozen=True)
class Version:
    path: str
    schema: T.StructType


class VersionStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _ledger(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.root}/ledger"):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.root}/ledger")

    def _append(self, entries: list[tuple[str, str | None, str | None]]) -> None:
        last = self._ledger().agg(F.max("seq")).first()[0] or 0
        columns = [[last + 1] * len(entries), *(list(c) for c in zip(*entries, strict=True))] if entries else [[]] * 4
        rows = pa.table([pa.array(c, kind) for c, kind in zip(columns, LEDGER_TYPES, strict=True)], names=LEDGER_NAMES)
        ledger = self.spark.createDataFrame(rows).coalesce(1)
        ledger.write.mode("append").parquet(f"{self.root}/ledger")

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> Version:
        """Write a version that nobody sees yet."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
        return Version(path, df.schema)

    def read(self, version: Version) -> DataFrame:
        return self.spark.read.schema(version.schema).parquet(version.path)

    def publish(self, versions: Mapping[str, Version], withdraw: Iterable[str] = ()) -> None:
        """Make written versions the current ones and withdraw names, all in one step."""
        written = [(name, v.path, v.schema.json()) for name, v in versions.items()]
        self._append([*written, *((name, None, None) for name in withdraw)])

    def names(self) -> list[str]:
        """The names that have a published version; a store holds a few tables."""
        last = self._ledger().groupBy("name").agg(F.max_by(F.struct("path"), "seq").alias("last"))
        return sorted(r["name"] for r in last.where("last.path IS NOT NULL").collect())

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write, publish and return ``df`` as the current version of ``name``."""
        version = self.write(df, name)
        self.publish({name: version})
        return self.read(version)

    def current(self, name: str) -> DataFrame | None:
        """The published version, or None."""
        latest = (
            self._ledger()
            .where(F.col("name") == name)
            .agg(F.max_by(F.struct("path", "schema"), "seq").alias("last"))
            .first()["last"]
        )
        if latest is None or latest["path"] is None:
            return None
        return self.read(Version(latest["path"], T.StructType.fromJson(json.loads(latest["schema"]))))

    def versions(self, prefix: str) -> dict[str, Version]:
        """The published versions of all names that begin with ``prefix``, by name."""
        last = (
            self._ledger()
            .where(F.col("name").startswith(prefix))
            .groupBy("name")
            .agg(F.max_by(F.struct("path", "schema"), "seq").alias("last"))
            .where("last.path IS NOT NULL")
            .select("name", "last.*")
            .collect()
        )
        schemas = {text: T.StructType.fromJson(json.loads(text)) for text in {row["schema"] for row in last}}
        return {row["name"]: Version(row["path"], schemas[row["schema"]]) for row in last}

    def parts(self, prefix: str) -> DataFrame | None:
        """The published versions of all names that begin with ``prefix``, tables of
        one schema, in one scan. None when there are none."""
        held = list(self.versions(prefix).values())
        if not held:
            return None
        return self.spark.read.schema(held[0].schema).parquet(*[v.path for v in held])

    def drop(self, name: str) -> bool:
        """Withdraw the published version. False, and no error, when there is none."""
        if self.current(name) is None:
            return False
        self._append([(name, None, None)])
        return True
