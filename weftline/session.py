"""Session construction."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "weftline", **conf: str) -> SparkSession:
    """Get or create a session with the settings the jobs rely on.

    Master, memory and shuffle width are left to the caller (``conf``) or to
    spark-submit; keyword names use ``__`` for the dots of a setting.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()
