"""One local session for all tests."""

from __future__ import annotations

import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g",
    }
    session = SparkSession.builder.master("local[8]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _value(x):
    if x is None or x != x:
        return None
    return f"{x:.8g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Checks a query against its SQL on a folder of Parquet tables."""
    import duckdb

    def check(query, sql: str, folder: str) -> int:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for f in os.listdir(folder):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
        got = query(spark, folder)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        a = Counter(tuple(map(_value, r)) for r in got.select(*names).collect())
        b = Counter(tuple(map(_value, r)) for r in want.fetchall())
        assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
        return sum(a.values())

    return check
