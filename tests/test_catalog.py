"""Every registered query of the library against its DuckDB SQL, or for rows alone, on the smallest tables."""

import math
import os

import duckdb
import pytest

from callweave.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "nation region benchmark customer orders lineitem events documents embeddings pages labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, D)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(plain, r)) for r in got.select(columns).collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
