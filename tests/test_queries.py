"""A few registered queries against DuckDB at the smallest scale; the driver compares them all."""

import os

import duckdb
import pytest

from quern.queries import every
from quern.session import TABLES

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = every()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    return "null" if x is None else f"{float(x):.6f}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["ag1_customer_value", "jn7_left_join_chain", "w5_reserve_stock", "jn16_as_of_join", "jn9_lookup", "fn18_unwind_group", "wn4_knn_batch", "jn14_ring", "pf24_window_join", "tx8_redo"])
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    at = [want.columns.index(c) for c in cols]
    rows = [[r[i] for i in at] for r in want.fetchall()]
    assert sorted([plain(v) for v in r] for r in got.select(*cols).collect()) == sorted([plain(v) for v in r] for r in rows)
