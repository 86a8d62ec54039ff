"""Every registered query of the forest library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from treesum.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "embeddings"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    def cell(v):
        if v is None or isinstance(v, (bool, str)):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
            f = float(v)
            return "nan" if math.isnan(f) else f"{f + 0.0:.9g}"
        return str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    ours = canonical([tuple(r[c] for c in cols) for r in got.collect()])
    at = [want.columns.index(c) for c in cols]
    assert ours == canonical([tuple(r[i] for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_fit_queries_return_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
