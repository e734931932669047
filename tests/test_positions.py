"""Distributed row numbers, running totals, chunked lists and the join of uneven keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from taxalake.operators import linkgraph as LG
from taxalake.operators import merge as MG
from taxalake.operators.positions import chunked_lists, numbered, running_total
from taxalake.operators.skewjoin import heavy_join, heavy_keys
from taxalake.sinks.snapshot import newest_partition, persisted, write_snapshot


def some_rows(seed, n=500):
    rng = random.Random(seed)
    return [(rng.choice([None, "hot", "hot", "hot", f"g{rng.randint(0, 40)}"]), rng.choice([None, *range(30)]), i) for i in range(n)]


SCHEMA = "g string, k int, i int"


def key(r):
    return (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])


@pytest.mark.parametrize("ranges", [None, 1, 13])
def test_numbers_of_a_total_order(spark, ranges):
    rows = some_rows(1)
    got = numbered(spark.createDataFrame(rows, SCHEMA).repartition(7), ["g", "k", "i"], ranges=ranges).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, len(rows) + 1))
    assert [tuple(r)[:3] for r in got] == sorted(rows, key=key)


def test_numbers_within_groups_that_span_ranges(spark):
    rows = some_rows(2)
    got = numbered(spark.createDataFrame(rows, SCHEMA), ["k", "i"], by=["g"], name="n", first=0, ranges=11).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(len(own)))
        assert [tuple(r)[:3] for r in own] == sorted((r for r in rows if r[0] == g), key=key)


def test_numbers_descending_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(None,)] * 5 + [(2,)] * 20, "k int")
    got = numbered(df, [F.col("k").desc_nulls_last()]).orderBy("position").collect()
    assert [r["k"] for r in got] == [2] * 20 + [1] * 50 + [None] * 5
    assert numbered(df.where("false"), ["k"]).collect() == []
    assert numbered(df.where("false"), ["k"], by=["k"]).collect() == []


def test_running_totals(spark):
    rows = some_rows(3)
    got = running_total(spark.createDataFrame(rows, SCHEMA), "k", ["i"], by=["g"]).collect()
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"]):
            assert r["before"] == total
            total += r["k"] or 0


def test_chunked_lists_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot", "same")] * 700 + [("hot", rng.choice([None, "a", "b", f"t{i}"])) for i in range(600)] + [(f"k{i % 90}", f"t{i}") for i in range(300)]
    got = chunked_lists(spark.createDataFrame(rows, "k string, v string"), ["k"], "v", 16).collect()
    assert max(len(r["values"]) for r in got) == 16
    by = {}
    for r in sorted(got, key=lambda r: (r["k"], r["chunk"])):
        assert r["chunk"] == len(by.setdefault(r["k"], [])) / 16  # all but the last are full
        by[r["k"]] += r["values"]
    for k, values in by.items():
        assert values == sorted((v for x, v in rows if x == k), key=lambda v: (v is not None, v or ""))


def test_term_lists_and_joined_members(spark):
    links = spark.createDataFrame([("NCBI:1", f"OTT:{i % 3}") for i in range(10)] + [("EOL:9", "OTT:1")], "ext string, term string")
    got = {r["chunk"]: r["terms"] for r in LG.term_lists(links, 4).collect()}
    assert got == {0: ["OTT:0"] * 4, 1: ["OTT:1"] * 3 + ["OTT:2"], 2: ["OTT:2"] * 2}
    members = spark.createDataFrame([("a|b", f"NCBI:{i}", 6, 2) for i in range(7)], "composite string, ext string, repeats long, key_length long")
    lines = sorted((r["chunk"], r["ids"]) for r in LG.joined_members(members, 3).collect())
    assert lines == [(0, "NCBI:0|NCBI:1|NCBI:2"), (1, "NCBI:3|NCBI:4|NCBI:5"), (2, "NCBI:6")]


def uneven(spark, tmp_path):
    left = [("hot" if i % 3 == 0 else f"k{i}", i) for i in range(3000)] + [(None, -1)] * 5
    right = [("hot", i) for i in range(40)] + [(f"k{i}", i) for i in range(0, 3000, 7)] + [("k1", -1), ("k1", -1), (None, 0)]
    spark.createDataFrame(left, "a string, x int").write.parquet(f"{tmp_path}/l")
    spark.createDataFrame(right, "b string, y int").write.parquet(f"{tmp_path}/r")
    return left, right, spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r")


def test_heavy_keys_are_exact(spark, tmp_path):
    left, _, df, _ = uneven(spark, tmp_path)
    assert [tuple(r) for r in heavy_keys(df, "a", 0.1, 1).collect()] == [("hot", 1000)]
    assert heavy_keys(df, "a", 0.1).collect() == [] == heavy_keys(df.where("false"), "a", 0.1, 1).collect()


def test_uneven_join_is_whole_and_even(spark, tmp_path):
    left, right, l, r = uneven(spark, tmp_path)
    want = Counter((a, x, b, y) for a, x in left for b, y in right if a is not None and a == b)
    joined = heavy_join(l, r, "a", "b", share=0.01, tasks=20, least_rows=1)
    assert Counter(map(tuple, joined.collect())) == want
    assert Counter(map(tuple, heavy_join(l, r, "a", "b").collect())) == want
    # a third of the rows have one key, whose pairs are most of the result: no task makes more than a few times its share
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        tasks = heavy_join(l, r, "a", "b", share=0.01, tasks=200, least_rows=1).groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(t["count"] for t in tasks) < 5 * sum(want.values()) / 64


def test_order_of_the_merged_map(spark):
    gmap = spark.createDataFrame([("b", None, "r", "n"), ("a", "x", "r", "n"), ("a", None, "r", "n"), ("a", "x", "r", "n")], ", ".join(f"{c} string" for c in MG.MAP_COLUMNS))
    terms = spark.createDataFrame([("Q1", ["T"], ["Q7"], [], ["r"])], "id string, names array<string>, rankIds array<string>, parentIds array<string>, sameAsIds array<string>")
    got = MG.in_order(MG.merge_map(gmap, terms), list(MG.MAP_COLUMNS)).orderBy("position").collect()
    assert [tuple(r) for r in got] == [
        ("a", None, "WD:Q1", "T", 1), ("a", None, "r", "n", 2), ("a", "x", "WD:Q1", "T", 3), ("a", "x", "r", "n", 4),
        ("b", None, "WD:Q1", "T", 5), ("b", None, "r", "n", 6),
    ]


def test_newest_partition_has_one_scan(spark, tmp_path):
    base = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a b", "20200101"), (2, "a b", "20210101"), (3, "c", "20220101")], "i int, source string, date string")
    write_snapshot(df, base, partition_by=("source", "date"))
    got = newest_partition(spark, base, "a b")
    assert [r["i"] for r in got.collect()] == [2]
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert newest_partition(spark, base, "nobody").collect() == []


def test_persisted_stage(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    with persisted(df) as kept:
        plan = kept.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in plan
        assert kept.groupBy("k").count().count() == 7
    assert not kept.is_cached


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_conflict_queries_read_the_links_once(spark, monkeypatch):
    from taxalake.plans import catalogue as C

    read = []
    whole = C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, path: (read.append(scans(df)), whole(df, path))[1])
    for name in ("conflicts_by_key_length", "conflicts_pair", "conflicts_single"):
        read.clear()
        C.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert read[0] == 3  # taxonomy, entity links and map; the rest reads what was written
