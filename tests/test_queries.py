"""Every engine query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from batchloom import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else int(v) if isinstance(v, bool) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, sql, name):
    found = registry.queries()[name](spark, SF)
    want = sql.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain(found.columns, found.collect()) == plain(columns, want.fetchall())
    spark.catalog.clearCache()
