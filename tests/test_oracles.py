"""Every query with SQL against DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from matchstats.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return con


def norm(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        if isinstance(x, (list, tuple)):
            return str([one(y) for y in x])
        return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = norm(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = duck.execute(registry.SQL[name])
    order = [c[0] for c in rel.description]
    assert sorted(order) == columns
    wanted = norm(tuple(r[order.index(c)] for c in columns) for r in rel.fetchall())
    assert found == wanted
