"""Export of tables to one folder and clean import with validation.

The manifest has a row per table and one per written file (``parts``), each with
its number of rows and exact digest; those of the parts add up to that of the table.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.digests import MEASURES, table_digest
from weftline.sources.versions import Version, VersionStore
from weftline.sources.workspace import side_by_side

MANIFEST, PARTS = "manifest", "parts"
DIGEST = ", ".join(f"{k} bigint" for k in MEASURES)
MANIFEST_SCHEMA = f"table string, {DIGEST}"
PARTS_SCHEMA = f"table string, part string, {DIGEST}"
NOTHING = (0,) * len(MEASURES)
NAMED_PARTS = 20  # in an error; damaged_parts has all
MISSING, UNLISTED, CHANGED = "missing", "unlisted", "changed"


class SnapshotError(RuntimeError):
    """The snapshot does not hold what its manifest says."""


def snapshot_export(spark: SparkSession, tables: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write every table below ``path``, the digests of the files written and last the
    manifest: ``table`` and ``MEASURES``. A folder without manifest is no snapshot.

    A table's digest is observed while its rows are written, those of its files come
    from reading them back; when they do not add up, what was written is not what was
    to be written, and no manifest is.
    """
    reserved = sorted({MANIFEST, PARTS} & set(tables))
    if reserved:
        raise SnapshotError(f"not a name for a table: {', '.join(reserved)}")

    def export(name: str) -> tuple[int, ...]:
        observed, seen = _observed(tables[name])
        observed.write.parquet(f"{path}/{name}")
        return _sums(seen)

    names = sorted(tables)
    meant = dict(zip(names, side_by_side(spark, [partial(export, n) for n in names]), strict=True))
    found = part_digests(spark, path, {n: tables[n].schema for n in names})
    found.coalesce(1).write.parquet(f"{path}/{PARTS}")
    written = _table_sums(read_parts(spark, path))
    for name in names:
        if written.get(name, NOTHING) != meant[name]:
            raise SnapshotError(f"{name}: {meant[name]} was to be written, {written.get(name, NOTHING)} was")
    manifest = spark.createDataFrame([(n, *meant[n]) for n in names], MANIFEST_SCHEMA)
    manifest.coalesce(1).write.parquet(f"{path}/{MANIFEST}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """``table``, ``part`` and ``MEASURES`` as recorded; files without rows are not listed."""
    return spark.read.schema(PARTS_SCHEMA).parquet(f"{path}/{PARTS}")


def part_digests(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """``table``, ``part`` and ``MEASURES`` of the files there are. One scan a table; only
    one row for each file and task is shuffled."""

    def of_table(name: str) -> DataFrame:
        df = spark.read.schema(schemas[name]).option("mode", "FAILFAST").parquet(f"{path}/{name}")
        held = df.groupBy(F.col("_metadata.file_name").alias("part")).agg(*table_digest(df.schema))
        return held.select(F.lit(name).alias("table"), "part", *MEASURES)

    found = [of_table(name) for name in sorted(schemas)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], PARTS_SCHEMA)


def damaged_parts(spark: SparkSession, path: str, schemas: Mapping[str, T.StructType]) -> DataFrame:
    """``table, part, problem, rows_listed, rows_found`` of every file that is missing,
    unlisted or changed. A file that is no Parquet any more stops the scan with
    Spark's error, which names it."""
    digest = F.struct(*MEASURES)
    listed = read_parts(spark, path).where(F.col("table").isin(sorted(schemas)))
    listed = listed.select("table", "part", digest.alias("listed"))
    there = part_digests(spark, path, schemas).select("table", "part", digest.alias("found"))
    problem = (
        F.when(F.col("found").isNull(), MISSING)
        .when(F.col("listed").isNull(), UNLISTED)
        .when(F.col("listed") != F.col("found"), CHANGED)
    )
    rows = (F.coalesce(f"{side}.rows", F.lit(0)).alias(f"rows_{side}") for side in ("listed", "found"))
    both = listed.join(there, ["table", "part"], "full")
    return both.select("table", "part", problem.alias("problem"), *rows).where("problem IS NOT NULL")


def snapshot_import_clean(
    spark: SparkSession, path: str, schemas: Mapping[str, T.StructType], store: VersionStore
) -> list[str]:
    """Replace all of the store's tables by those of a snapshot, all or nothing.

    Every table of the manifest needs its schema, and a table of the store that the
    snapshot lacks is withdrawn in the same step.

    Every table is read with its fixed schema and copied; its digest is observed on
    the way. Only when all agree with the manifest are the copies published. On a
    disagreement nothing is published, readers stay on what they had, and the
    files of that table are read again to name the damaged ones.
    """
    expected = {r["table"]: tuple(r[k] for k in MEASURES) for r in read_manifest(spark, path).collect()}
    missing = sorted(set(schemas) - set(expected))
    if missing:
        raise SnapshotError(f"not in the snapshot: {', '.join(missing)}")
    unnamed = sorted(set(expected) - set(schemas))
    if unnamed:
        raise SnapshotError(f"in the snapshot but without a schema: {', '.join(unnamed)}")

    def copy(name: str) -> Version:
        df = spark.read.schema(schemas[name]).option("mode", "FAILFAST").parquet(f"{path}/{name}")
        observed, seen = _observed(df)
        version = store.write(observed, name)
        if _sums(seen) != expected[name]:
            damaged = damaged_parts(spark, path, {name: schemas[name]}).orderBy("part").take(NAMED_PARTS)
            named = ", ".join(f"{r['part']} {r['problem']}" for r in damaged)
            raise SnapshotError(f"{name}: manifest says {expected[name]}, data is {_sums(seen)}: {named}")
        return version

    names = sorted(schemas)
    copies = dict(zip(names, side_by_side(spark, [partial(copy, n) for n in names]), strict=True))
    store.publish(copies, withdraw=sorted(set(store.names()) - set(copies)))
    return names


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with its digest taken while it is written."""
    seen = Observation()
    return df.observe(seen, *table_digest(df.schema)), seen


def _sums(seen: Observation) -> tuple[int, ...]:
    return tuple(seen.get[k] for k in MEASURES)


def _table_sums(parts: DataFrame) -> dict[str, tuple[int, ...]]:
    """A row per table is fetched, a snapshot holds a few."""
    sums = [F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in MEASURES]
    found = parts.groupBy("table").agg(*sums).collect()
    return {r["table"]: tuple(int(r[k]) for k in MEASURES) for r in found}
