"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from streamgauge.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    q = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in q.description]
    want = q.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want), key=str)


def test_one_exchange_for_entity_and_context(spark):
    from streamgauge.operators import history

    df = catalogue.events(spark, SF)
    out = history.context_history(history.entity_history(df, catalogue.spec()), catalogue.spec())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
