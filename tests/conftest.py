from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config(
            "spark.sql.shuffle.partitions", "4",
        ).config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", scratch).config(
            "spark.sql.warehouse.dir", f"{scratch}/warehouse",
        )
        .config("spark.checkpoint.dir", f"file://{scratch}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def rounded(rows):
    """Rows as sorted tuples that floats' last bits don't tell apart."""
    flat = [tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(flat, key=lambda r: tuple((v is None, str(v)) for v in r))


def same_as_sql(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    rel = duck.sql(sql)
    assert names == sorted(rel.columns)
    theirs = rel.project(", ".join(f'"{c}"' for c in names)).fetchall()
    assert rounded(map(tuple, df.select(*names).collect())) == rounded(theirs)
