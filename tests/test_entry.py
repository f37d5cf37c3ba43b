from __future__ import annotations

import os

import pytest

SMALL = "/root/testdata/sf0.001"


def test_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) > 60 and set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "candidate" in df.columns


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", ["degree_stats", "gate_sweep", "cluster_bootstrap", "stable_seed", "knn_mutual", "delaunay", "holm", "youden"])
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.sql(f"create view {t[:-8]} as select * from '{SMALL}/{t}'")
    df = e.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    cur = con.execute(e.oracle_sql()[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    norm = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(norm(r[at.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want
