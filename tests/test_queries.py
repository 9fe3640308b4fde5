import math

import duckdb
import pytest

import __spark_entry__ as entry
from tickframe.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return int(v) if isinstance(v, bool) else v


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [[plain(r[c]) for c in columns] for r in df.collect()]
    assert rows
    if name not in SQL:
        return
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [[plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()]
    order = lambda r: ([str(x) for x in r if not isinstance(x, float)], [round(x, 3) for x in r if isinstance(x, float)])
    assert len(rows) == len(want)
    for a, b in zip(sorted(rows, key=order), sorted(want, key=order)):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "ts", "close", "fast", "slow", "crosses_up", "crosses_down"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
