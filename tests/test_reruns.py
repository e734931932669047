"""Listed files, a file a row, and reruns by a manifest."""

import os

import pytest
from pyspark.sql import functions as F

from taxalake.operators.sideload import sideload_text
from taxalake.sinks import files as FS
from taxalake.sources import listed
from taxalake.sources.listed import read_files
from taxalake.sources.raster import decode_units
from taxalake.sources.text import read_texts


def test_empty_files_are_empty_texts(spark, tmp_path):
    (tmp_path / "a_djvu.txt").write_text("")
    (tmp_path / "b_djvu.txt").write_text("täxt\nlines")
    (tmp_path / "c_djvu.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "d.txt").write_text("other suffix")
    (tmp_path / ".hidden_djvu.txt").write_text("hidden")
    items = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), (None,)], "barcode string")
    got = {r["barcode"]: r["ocrtext"] for r in sideload_text(items, read_texts(spark, str(tmp_path), null_on_bad_utf8=True)).collect()}
    assert got == {"a": "", "b": "täxt\nlines", "c": None, "x": None, None: None}


def test_folders_globs_and_uris(spark, tmp_path):
    for d in ("x1", "x2", "y"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.txt").write_text(d)
    names = lambda p: sorted(r["content"].decode() for r in read_files(spark, p).collect())
    assert names(f"{tmp_path}/x1") == ["x1"]
    assert names(f"{tmp_path}/x*/f.txt") == ["x1", "x2"] == names(f"{tmp_path}/x*")
    assert names(f"file:{tmp_path}/y") == ["y"] == names(f"file://{tmp_path}/y")
    (tmp_path / "none").mkdir()
    assert names(f"{tmp_path}/none") == []
    with pytest.raises(Exception):
        names(f"{tmp_path}/missing")


def test_listing_makes_bounded_batches(spark, tmp_path, monkeypatch):
    rows = spark.range(700).select(F.concat(F.col("id").cast("string"), F.lit(".bin")).alias("name"), F.col("id").cast("string").alias("content"))
    assert FS.write_files(rows.union(spark.createDataFrame([(None, "x"), ("n", None)], "name string, content string")), str(tmp_path / "f")) == 700
    batches = listed.FilesReader({"path": str(tmp_path / "f")}).partitions()
    assert [len(b.paths) for b in batches] == [256, 256, 188]
    monkeypatch.setattr(listed, "BYTES", 300)
    assert len(listed.FilesReader({"path": str(tmp_path / "f")}).partitions()) > 5
    got = read_files(spark, str(tmp_path / "f"))
    assert got.count() == 700 and got.where(F.col("content").cast("string") != F.regexp_extract("name", r"^(\d+)", 1)).count() == 0


def tile(name, add):
    return name, b"".join((i + add).to_bytes(2, "big", signed=True) for i in range(9))


def write_tiles(folder, tiles):
    os.makedirs(folder, exist_ok=True)
    for name, content in tiles:
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)


def units(spark, folder):
    return read_files(spark, folder, ".hgt").select(F.col("name").alias("unit"), "content")


def test_only_new_and_changed_tiles_are_done(spark, tmp_path):
    folder, log = str(tmp_path / "t"), str(tmp_path / "log")
    write_tiles(folder, [tile("N01E001.hgt", 0), tile("S02W003.hgt", 100), ("bad.hgt", b"x")])
    done = []

    def work(todo):
        done.append(sorted(r["unit"] for r in todo.select("unit").collect()))
        return decode_units(samples=3)(todo)

    assert FS.run_new(units(spark, folder), log, work) == 3  # the bad one is done, and gives no cells
    assert FS.run_new(units(spark, folder), log, work) == 0
    write_tiles(folder, [tile("S02W003.hgt", 500), tile("N05E005.hgt", 1)])
    os.remove(f"{folder}/N01E001.hgt")
    assert FS.run_new(units(spark, folder), log, work) == 2
    assert done == [["N01E001.hgt", "S02W003.hgt", "bad.hgt"], [], ["N05E005.hgt", "S02W003.hgt"]]
    got = {(r["tile"], r["version"], r["n"], r["least"]) for r in FS.results(spark, log).groupBy("tile", "version").agg(F.count("*").alias("n"), F.min("height").alias("least")).collect()}
    assert got == {("N01E001", 1, 9, 0), ("S02W003", 3, 9, 500), ("N05E005", 3, 9, 1)}


def test_a_run_that_dies_leaves_the_former_version(spark, tmp_path):
    folder, log = str(tmp_path / "t"), str(tmp_path / "log")
    write_tiles(folder, [tile("N01E001.hgt", 0)])
    FS.run_new(units(spark, folder), log, decode_units(samples=3))
    write_tiles(folder, [tile("N01E001.hgt", 50)])

    def dies(todo):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        FS.run_new(units(spark, folder), log, dies)
    assert FS.results(spark, log).agg(F.max("height")).first()[0] == 8
    assert FS.run_new(units(spark, folder), log, decode_units(samples=3)) == 1
    assert FS.results(spark, log).agg(F.min("height")).first()[0] == 50


def test_two_runs_at_once(spark, tmp_path):
    folder, log = str(tmp_path / "t"), str(tmp_path / "log")
    write_tiles(folder, [tile("N01E001.hgt", 0)])

    def overtaken(todo):
        FS.run_new(units(spark, folder), log, decode_units(samples=3))
        return decode_units(samples=3)(todo)

    with pytest.raises(RuntimeError):
        FS.run_new(units(spark, folder), log, overtaken)
    assert FS.results(spark, log).count() == 9


def test_no_run_yet(spark, tmp_path):
    with pytest.raises(ValueError):
        FS.results(spark, str(tmp_path / "log"))
    assert FS.finished(spark, str(tmp_path / "log")).count() == 0
