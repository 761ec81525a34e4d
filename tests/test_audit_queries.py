"""Every audit query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tracewright import queries as audit

FOLDER = "/root/testdata/sf0.001"


def plain(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    frame = frame.map(lambda v: round(v, 9) if isinstance(v, float) else v).astype(str).replace(r"\.0$", "", regex=True)
    return names, sorted(map(tuple, frame.to_numpy().tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(audit.queries()))
def test_query(spark, duck, name):
    assert plain(audit.queries()[name](spark, FOLDER).toPandas()) == plain(duck.execute(audit.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
