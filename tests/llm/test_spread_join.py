"""The join of hot keys against Python."""

from collections import Counter

from taxalake.llm import common


def test_spread_join(spark):
    rows = [(7 if i % 3 == 0 else i % 900, i) for i in range(6000)] + [(None, -1), (-5, -2)]
    n = Counter(k for k, _ in rows)
    side = [(k, n[k], f"v{k}") for k in n if k is not None and k >= 0 and k % 2]
    frame = spark.createDataFrame(rows, "key long, i long")
    table = spark.createDataFrame(side, "key long, n long, v string")
    expected = sorted((k, i, f"v{k}") for k, i in rows if k is not None and k >= 0 and k % 2)
    for most in (1, 10, 1000, 10**6):
        got = common.spread_join(frame, table, "key", "n", most)
        assert got.columns == ["key", "i", "v"]
        assert sorted(map(tuple, got.collect())) == expected
    # a hot key's rows are dealt over many partitions, and none is lost in an empty side
    got = common.spread_join(frame.repartition(4), table, "key", "n").where("key = 7")
    assert got.count() == n[7]
    assert common.spread_join(frame, table.limit(0), "key", "n").count() == 0


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, 2, 3), (1, 4, 5)], "key long, _hot long, _other long")
    table = spark.createDataFrame([(1, 2, "a")], "key long, n long, v string")
    assert sorted(map(tuple, common.spread_join(frame, table, "key", "n", 10).collect())) == [(1, 2, 3, "a"), (1, 4, 5, "a")]
