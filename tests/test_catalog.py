"""Every query with SQL gives what DuckDB gives on the same tables."""
from __future__ import annotations

import duckdb
import pytest

from calibra.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, cols):
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in at) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_scan_reads_only_what_it_needs(spark):
    df = catalog.QUERIES["scan_prune"](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[-1]
