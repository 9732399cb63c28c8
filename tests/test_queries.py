"""Every registered voxel query against its SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from voxspark.jobs import catalog


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    return c


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    result = db.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert len(got) == len(want) and all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_known_values(spark, sf):
    q = catalog.QUERIES
    assert tuple(q["mask_stats"](spark, sf).first())[0] > 2000
    rows = {r.candidate: r for r in q["lcc_candidates_chunked"](spark, sf).collect()}
    assert min(rows, key=lambda i: rows[i].lcc) == 0 and rows[0].lcc < 1e-3


def test_driver_contract(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalog.QUERIES["crop_part"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
