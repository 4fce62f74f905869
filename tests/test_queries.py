"""Every registered query of the main library against its SQL, on the smallest tables."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest

from lectern.plans import files, more, oracle
from lectern.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
assert files  # registers its queries on import
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(frame):
    def one(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fiu" or isinstance(v, int) and not isinstance(v, bool):
            return f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def results(spark, request):
    """The chosen queries' rows. Planning takes longer than these tables' rows, so a few run at a time."""
    chosen = [item.callspec.params["name"] for item in request.session.items if item.module is request.module and hasattr(item, "callspec")]
    with ThreadPoolExecutor(5) as pool:
        yield {name: pool.submit(lambda f=QUERIES[name]: f(spark, DIR).toPandas()) for name in chosen}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, duck, name):
    got = results[name].result()
    if sql := (oracle.SQL | more.SQL).get(name):
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["chapter", "phrase", "count", "first"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
