"""Every query against its SQL on the smallest tables, where those are there."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quillspark.plans.registry import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(float(v), 6) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(None if r[i] is None else tidy(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, str(DATA))
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_native_paths_have_no_python(spark):
    if DATA.exists():
        for name in ("source_profile", "sanitized_documents", "required_fact_coverage", "claim_queue_topk"):
            plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    if DATA.exists():
        plan = QUERIES["table_query"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(o_orderstatus,F)" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]
