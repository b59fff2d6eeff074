"""Every core query against its SQL in DuckDB, on the smallest test tables where they are present."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from palimpsest.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)) or "Decimal" in type(v).__name__:
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    sql = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [sql.columns.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
