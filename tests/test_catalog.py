"""Queries against their SQL, run by DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from loomfield.plans import catalog

CHECKED = sorted(catalog.ORACLES)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, small, duck, name):
    assert rows(catalog.QUERIES[name](spark, small).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 4
