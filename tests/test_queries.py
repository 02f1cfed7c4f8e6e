"""Every domain query against its SQL on the smallest tables, and the entry point's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from gridloom.plans import catalog
from gridloom.plans.adapters import GIVEN
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in GIVEN:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        return
    sql = catalog.ORACLE_SQL[name]
    assert sorted(duck.sql(sql).columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows == sorted((tuple(plain(v) for v in r) for r in duck.sql(f"SELECT {picked} FROM ({sql})").fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
