"""Bounded first-n."""

from pyspark.sql import functions as F

from taxalake.operators.topk import first_rows, top_n


def test_first_rows(spark):
    df = spark.range(0, 10_000, numPartitions=7)
    for n in (1, 1500, 9_999, 10_000, 20_000):
        out = first_rows(df, n)
        assert out.count() == min(n, 10_000)
        assert out.distinct().count() == min(n, 10_000)


def test_top_n(spark):
    df = spark.range(0, 10_000, numPartitions=7).select(((F.col("id") * 7919) % 10_000).alias("k"), "id")
    for n in (1, 333, 5_000, 10_000, 12_000):
        asc = sorted(r.k for r in top_n(df, "k", n).collect())
        assert asc == list(range(min(n, 10_000)))
        desc = sorted(r.k for r in top_n(df, "k", n, ascending=False).collect())
        assert desc == list(range(10_000 - min(n, 10_000), 10_000))


def test_top_n_with_null_keys(spark):
    df = spark.range(0, 1000, numPartitions=5).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), "id"
    )
    asc = [r.k for r in top_n(df, "k", 120).orderBy(F.col("k").asc()).collect()]
    assert asc[:100] == [None] * 100 and asc[100:] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19, 21, 22]
    desc = sorted(r.k for r in top_n(df, "k", 5, ascending=False).collect())
    assert desc == [995, 996, 997, 998, 999]
    alln = top_n(df, "k", 950, ascending=False).collect()
    assert len(alln) == 950 and sum(r.k is None for r in alln) == 50


def test_top_n_string_key(spark):
    df = spark.range(0, 30_000, numPartitions=6).select(F.format_string("k%06d", (F.col("id") * 7919) % 30_000).alias("k"))
    for n in (10, 2500):
        got = sorted(r.k for r in top_n(df, "k", n).collect())
        assert got == [f"k{i:06d}" for i in range(n)]
        got = sorted(r.k for r in top_n(df, "k", n, ascending=False).collect())
        assert got == [f"k{i:06d}" for i in range(30_000 - n, 30_000)]


def test_top_n_two_columns(spark):
    df = spark.range(0, 5000, numPartitions=4).select((F.col("id") % 50).alias("a"), (F.col("id") * 31 % 5000).alias("b"))
    want = sorted(((r.a, r.b) for r in df.collect()))[:777]
    got = sorted((r.a, r.b) for r in top_n(df, ["a", "b"], 777).collect())
    assert got == want
