"""Every registered query against its SQL twin on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.plans.catalog import load
from plumbline.plans.fixtures import TABLES, VIEWS, sql, view

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def comparable(value):
    if value is None:
        return ("null", "")
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, (int, float, Decimal)):
        number = float(value)
        return ("number", "nan" if math.isnan(number) else f"{number:.10g}")
    return ("text", str(value))


def rows_of(names, rows):
    order = sorted(names)
    return sorted(tuple(comparable(r[names.index(n)]) for n in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    got = [tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in df.columns]).collect()]
    assert got
    if name not in ORACLES:
        return
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", list(VIEWS))
def test_derived_view(spark, db, name):
    """A derived view holds the same rows in both engines."""
    df = view(spark, SF_DIR, name)
    cols = [F.date_format(f"`{c}`", "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(f"`{c}`")
            for c, t in df.dtypes]
    shown = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" if t.startswith("timestamp") else c
                      for c, t in df.dtypes)
    cursor = db.execute(f"SELECT {shown} FROM {sql(name)} v")
    assert rows_of(df.columns, [tuple(r) for r in df.select(*cols).collect()]) == rows_of(
        [d[0] for d in cursor.description], cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as driver
    assert driver.entry(spark).count() == 15
    assert set(driver.oracle_sql()) <= set(driver.queries())
