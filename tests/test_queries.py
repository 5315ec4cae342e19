import glob
import math
import os

import duckdb
import pytest

from quarry.plans import flow_queries, page_queries, queries, record_queries, tool_queries  # noqa: F401  they register
from quarry.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(names)
    want = sorted((tuple(plain(dict(zip(names, r))[k]) for k in key) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in key) for r in df.collect()), key=repr) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
