"""Run registered queries against their DuckDB twins.

``python tests/compare.py [name ...]`` uses $WEFTLINE_SF_DIR or sf0.01.
"""

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, sf_dir, query, sql):
    """None when equal, else a short description of the difference."""
    start = time.time()
    df = query(spark, sf_dir)
    spark_rows = normal([tuple(r) for r in df.collect()], df.columns)
    spark_s = time.time() - start
    if sql is None:
        return f"rows only: {len(spark_rows)}", len(spark_rows), spark_s, 0.0
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    duck_rows = normal(result.fetchall(), columns)
    duck_s = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", 0, spark_s, duck_s
    if spark_rows != duck_rows:
        only_spark = [r for r in spark_rows if r not in set(duck_rows)][:3]
        only_duck = [r for r in duck_rows if r not in set(spark_rows)][:3]
        return (
            f"{len(spark_rows)} / {len(duck_rows)} rows\n spark {only_spark}\n duck  {only_duck}",
            len(spark_rows),
            spark_s,
            duck_s,
        )
    return None, len(spark_rows), spark_s, duck_s


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    sf = os.environ.get("WEFTLINE_SF_DIR", "/root/testdata/sf0.01")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    wanted = sys.argv[1:] or list(e.queries())
    for key in wanted:
        bad, n, a, b = check(session, connection, sf, e.queries()[key], e.oracle_sql().get(key))
        print(f"{'ok  ' if bad is None else 'DIFF'} {key:28s} {n:7d} rows  spark {a:6.2f}s duck {b:6.2f}s {bad or ''}", flush=True)
