from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare():
    """Runs a query and its SQL over the same tables; returns both as sorted lists of rows with columns by name."""
    import glob

    import duckdb

    def views(folder: str):
        c = duckdb.connect()
        c.sql("set timezone='UTC'")
        for p in glob.glob(f"{folder}/*.parquet"):
            source = p + "/*.parquet" if os.path.isdir(p) else p
            c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{source}'")
        return c

    def key(v):
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)

    def run(spark, entry, name: str, folder: str):
        df = entry.queries()[name](spark, folder)
        rows = df.collect()
        rel = views(folder).sql(entry.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        a, b = sorted(df.columns), rel.columns
        mine = sorted(tuple(key(r[c]) for c in a) for r in rows)
        theirs = sorted(tuple(key(r[b.index(c)]) for c in a) for r in rel.fetchall())
        return mine, theirs

    return run
