"""Session helpers and small building blocks the queries rely on."""

from pyspark.sql import functions as F

from taxalake.functions.ids import key_length
from taxalake.functions.once import select_once
from taxalake.session import checkpoint_root, scratch_path


def test_checkpoint_root_and_scratch(spark):
    root = checkpoint_root(spark)
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        assert root == conf.rstrip("/")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(root + "/scratch/x-")


def test_select_once_keeps_one_parse(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',)], "v string")
    parsed = select_once(df, F.from_json("v", "a int, b int").alias("j"))
    out = parsed.where((F.col("j.a") == 1) & (F.col("j.b") == 2)).select("j.a", "j.b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1
    assert out.collect()[0].asDict() == {"a": 1, "b": 2}


def test_key_length_java_rules(spark):
    df = spark.createDataFrame([("a|b|c",), ("a",), ("a||b",), ("|a",), ("a|",)], "k string")
    assert [r.n for r in df.select(key_length(F.col("k")).alias("n")).collect()] == [3, 1, 3, 2, 1]
