"""Every query that has SQL against an independent engine over the smallest tables."""

import glob
import math
import os

import pytest

from tessella.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, engine, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = engine.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_sql_run(spark, engine, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0
