"""Every query with a SQL twin against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from scanlake import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = queries.queries()[name](spark, SMALL)
    columns = sorted(found.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert columns == sorted(want.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in found.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_query_plans_as_a_cross_join(spark, name):
    plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__

    assert os.path.isdir(SMALL) and __spark_entry__.entry(spark).count() > 0


def test_library_does_not_import_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(queries.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "scanlake.llm" in p.read_text()]
