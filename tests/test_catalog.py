"""Every query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from lexicrate import catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations", "events", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, SF)
    rows = plain(map(tuple, out.select(*sorted(out.columns)).collect()))
    spark.catalog.clearCache()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(out.columns)
        columns = ", ".join(f'"{c}"' for c in sorted(out.columns))
        assert rows == plain(duck.sql(f"select {columns} from want").fetchall())
    else:
        assert rows


@needs_data
def test_entry_points(spark):
    assert set(catalog.QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0
