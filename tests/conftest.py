import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL: the same columns and rows, in any order."""

    def check(run, sql):
        df = run(spark, SF)
        columns = sorted(df.columns)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        theirs = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
        ours = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
        assert ours == theirs

    return check
