"""Tables written on the way, in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a
    cluster session without it is an error, since executors would not share it.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="weftline-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to."""
    return f"{shared_folder(spark)}/weftline/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether something was written at ``path``, on whatever store it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the partition folders (``name=value``) directly below ``path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)
    return sorted(f.getPath().getName() for f in found if f.isDirectory() and "=" in f.getPath().getName())


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Submit Spark jobs side by side; their results in order. The first failure is raised."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so later uses neither recompute it nor
    depend on the executors that made it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
