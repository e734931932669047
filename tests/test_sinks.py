"""Sinks: snapshots, rerun guard, editions, delimited export, partitioned layout."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxalake.operators.manifest import missing_manifest, only_new
from taxalake.sinks import snapshot as SN
from taxalake.sources.delimited import read_delimited


def test_stamp_and_names():
    assert SN.stamp_of(dt.datetime(2017, 6, 7, 18, 37, 47)) == "20170607T183747"
    assert SN.snapshot_name("/d/", "idigbio", "20170607T183747", "100k") == "/d/idigbio-20170607T183747-100k.parquet"
    assert SN.snapshot_path("/g", "globi", "20180305", "taxonMap.tsv") == "/g/source=globi/date=20180305/taxonMap.tsv"


def test_existing_output_fails_unless_overwrite(spark, tmp_path):
    df = spark.range(5)
    p = str(tmp_path / "snap.parquet")
    SN.write_snapshot(df, p)
    with pytest.raises(Exception):
        SN.write_snapshot(df, p)
    SN.write_snapshot(spark.range(3), p, overwrite=True)
    assert spark.read.parquet(p).count() == 3


def test_editions(spark, tmp_path):
    df = spark.range(250)
    written = SN.write_editions(df, str(tmp_path), "x", "20240101T000000", {"100": 100, "1k": 1000})
    counts = {r.edition: r.n_rows for r in SN.edition_counts(spark, written).collect()}
    assert counts == {"all": 250, "100": 100, "1k": 250}
    ordered = SN.write_editions(df, str(tmp_path / "o"), "x", "20240101T000000", {"10": 10}, order=["id"])
    assert sorted(r.id for r in spark.read.parquet(ordered["10"]).collect()) == list(range(10))


def test_export_delimited_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "k string, v string")
    p = SN.export_delimited(df, str(tmp_path / "out.tsv"), single_file=True, sort_by=["k"])
    parts = [f for f in (tmp_path / "out.tsv").iterdir() if f.name.startswith("part-")]
    assert len(parts) == 1
    back = {r.k: r.v for r in read_delimited(spark, p).collect()}
    assert back == {"a": None, "b": None, "c": "x"}  # "" and null both read back as null


def test_partitioned_layout_prunes(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "globi", "20180125"), (2, "globi", "20180305"), (3, "ott", "20170226"), (4, "globi", "20180305")],
        "id int, source string, date string",
    )
    base = str(tmp_path / "data")
    SN.write_snapshot(df, base, partition_by=("source", "date"))
    t = spark.read.parquet(base)
    latest = SN.latest_snapshot(t, "globi")
    assert sorted(r.id for r in latest.collect()) == [2, 4]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_manifest_and_only_new(spark):
    keys = spark.createDataFrame([("b1",), ("b2",), (None,)], "barcode string")
    present = spark.createDataFrame([("b1_djvu.txt",)], "file string")
    m = {(r.key, r.suffix): r for r in missing_manifest(keys, present).collect()}
    assert set(m) == {("b1", "_files.xml"), ("b2", "_djvu.txt"), ("b2", "_files.xml"), (None, "_djvu.txt"), (None, "_files.xml")}
    assert m[("b2", "_djvu.txt")].remote_fn == "http://archive.org/download/b2/b2_djvu.txt"
    assert m[("b2", "_djvu.txt")].local_fn == "data/mirror/b2_djvu.txt"
    assert m[(None, "_djvu.txt")].problem == "null key"
    units = spark.createDataFrame([("N10E020",), ("S10W020",)], "tile string")
    done = spark.createDataFrame([("N10E020",)], "tile string")
    assert [r.tile for r in only_new(units, done, "tile").collect()] == ["S10W020"]


def test_sorted_export_splits_a_hot_key(spark, tmp_path):
    df = spark.range(20_000).select(
        F.when(F.col("id") < 10_000, F.lit("HOT")).otherwise(F.format_string("k%05d", F.col("id"))).alias("id"),
        F.format_string("n%05d", F.col("id")).alias("name"),
    )
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # small data: keep the 8 range partitions apart
    try:
        p = SN.export_delimited(df.repartition(8), str(tmp_path / "sorted.tsv"), sort_by=["id"])
    finally:
        spark.conf.set(key, before)
    parts = sorted(f for f in (tmp_path / "sorted.tsv").iterdir() if f.name.startswith("part-"))
    hot_files = [f for f in parts if "HOT" in f.read_text()]
    assert len(hot_files) > 1  # the hot key is spread over several part files
    back = [ln.split("\t")[0] for f in parts for ln in f.read_text().splitlines()[1:]]
    assert back == sorted(back)  # part files concatenate in order


def test_partitioned_snapshot_rebalances(spark, tmp_path):
    df = spark.range(60_000, numPartitions=12).select(
        "id", F.xxhash64("id").alias("x"), F.when(F.col("id") < 50_000, F.lit("hot")).otherwise(F.lit("cold")).alias("source")
    )
    base = str(tmp_path / "p")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        SN.write_snapshot(df, base, partition_by=("source",))
    finally:
        spark.conf.set(key, before)
    files = {v: [f for f in (tmp_path / "p" / f"source={v}").iterdir() if f.name.endswith(".parquet")] for v in ("hot", "cold")}
    assert len(files["hot"]) > len(files["cold"]) >= 1  # the hot value is written by several tasks
    assert spark.read.parquet(base).count() == 60_000


def test_editions_read_only_the_files_they_need(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.range(1000, numPartitions=10).write.parquet(path)
    part = SN._leading_files(spark, spark.read.parquet(path), 250)
    assert len(part.inputFiles()) == 3 and part.count() == 300
    assert len(SN._leading_files(spark, spark.read.parquet(path), 5000).inputFiles()) == 10
