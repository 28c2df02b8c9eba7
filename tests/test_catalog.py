"""Every query of the time-series engine, against DuckDB where there is SQL for it."""

import math

import duckdb
import pytest

from tideglass import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(small_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.5g}" if hasattr(v, "as_tuple") or isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, small_dir, name):
    df = catalog.QUERIES[name](spark, small_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_flagship(spark, small_dir):
    row = catalog.flagship(spark, small_dir).first()
    assert row["best_score"] == pytest.approx(row["alarm_score"], abs=1e-6)
