"""Driver contract, oracle agreement on a few queries, and plan shape checks."""

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from taxalake.plans.catalogue import QUERIES
from taxalake.plans.oracles import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_ids > 0
    assert df.columns[0] == "total_ids"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) >= 50 and set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_agreement_small(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    a = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in res.description]
    b = sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and a == b


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_row_at_a_time_python(spark, name):
    """Only the raster decoder may leave the JVM, and only through Arrow batches."""
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    # no all-pairs joins, no funnel of a whole input into one partition: a
    # single-partition exchange may only carry partial aggregates (one row per
    # partition into a global aggregate)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "CollectLimit"):
        assert bad not in plan, bad
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "partial_" in lines[i + 1], lines[i + 1]


def test_composites_one_scan_no_join(spark):
    plan = plan_of(E.queries()["composites"](spark, SF_SMALL))
    assert "Join" not in plan
    assert plan.count("Scan parquet") == 3  # lineitem, part, orders: each read once


def test_every_query_lists_its_inventory_ids():
    from taxalake.plans.catalogue import COVERS

    assert set(COVERS) == set(QUERIES)


def test_every_inventory_id_is_reached():
    from taxalake.plans.catalogue import COVERS, FIXTURE_ONLY

    reached = set(" ".join([*COVERS.values(), FIXTURE_ONLY]).split())
    sizes = {"S": 10, "K": 9, "V": 9, "F": 16, "X": 25, "J": 5, "A": 22, "L": 11, "E": 6}
    assert reached == {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)}
