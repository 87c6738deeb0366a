import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stratakv import queries
from stratakv.plans import compaction

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    places = [want.columns.index(c) for c in names]
    assert got == sorted(repr(tuple(r[p] for p in places)) for r in want.fetchall())


@pytest.fixture
def sorted_ranges(monkeypatch):
    """Into how many ranges each write sorts its entries, where few bytes are a range."""
    asked, by_ranges = [], compaction.by_ranges
    monkeypatch.setattr(compaction, "RANGE_BYTES", 1000, raising=False)
    monkeypatch.setattr(compaction, "by_ranges", lambda entries, parts=None: asked.append(parts) or by_ranges(entries, parts))
    return asked


def test_one_file_is_sorted_by_several_tasks(spark, duck, sorted_ranges):
    """sst_blocks: no task sorts all entries of its one file, and the result stays."""
    got = queries.QUERIES["sst_blocks"](spark, DIR).collect()
    assert sorted_ranges and min(sorted_ranges) > 1
    assert [tuple(r) for r in got] == duck.sql(queries.ORACLE_SQL["sst_blocks"]).fetchall()


def test_blocks_of_a_file_are_not_put_in_order_by_one_task(spark):
    assert "Window" not in queries.QUERIES["sst_blocks"](spark, DIR)._jdf.queryExecution().toString()


def test_the_file_of_meta_blocks_is_sorted_by_several_tasks(spark, duck, sorted_ranges):
    """sst_meta: a file joined of ranges has one index and one block of properties."""
    got = queries.QUERIES["sst_meta"](spark, DIR).collect()
    assert sorted_ranges and min(sorted_ranges) > 1
    assert sorted(tuple(r) for r in got) == sorted(duck.sql(queries.ORACLE_SQL["sst_meta"]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert queries.QUERIES["sst_blocks"](spark, DIR).count() > 0
