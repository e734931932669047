"""File sources: keyed text mirror, binary elevation tiles, incremental reruns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxalake.operators.sideload import sideload_text, text_coverage
from taxalake.sources.raster import decode_tiles, tile_files, tile_rejects
from taxalake.sources.text import read_texts
from taxalake.streaming.incremental import convert_new_tiles, sideload_new_texts


@pytest.fixture()
def mirror(tmp_path):
    d = tmp_path / "mirror"
    d.mkdir()
    (d / "bc1_djvu.txt").write_text("page one\npage two\n")
    (d / "bc3_djvu.txt").write_bytes(b"bad \xff byte")
    (d / "bc4_djvu.txt").write_bytes(b"")
    (d / "bc1_files.xml").write_text("<files/>")  # other suffix: ignored
    return d


def test_read_texts_and_sideload(spark, mirror):
    texts = read_texts(spark, str(mirror))
    got = {r.barcode: r.text for r in texts.collect()}
    assert set(got) == {"bc1", "bc3", "bc4"}
    assert got["bc4"] == ""  # an empty file is empty text
    assert got["bc1"] == "page one\npage two\n"
    assert "�" in got["bc3"]
    strict = {r.barcode: r.text for r in read_texts(spark, str(mirror), null_on_bad_utf8=True).collect()}
    assert strict["bc3"] is None
    items = spark.createDataFrame([(1, "bc1"), (2, "bc2"), (3, None), (4, "bc3")], "itemid int, barcode string")
    joined = {r.itemid: r.ocrtext for r in sideload_text(items, texts).collect()}
    assert joined == {1: "page one\npage two\n", 2: None, 3: None, 4: got["bc3"]}
    cov = text_coverage(sideload_text(items, texts)).collect()[0]
    assert (cov.n_rows, cov.n_with_text) == (4, 2)


def tile_bytes(n, nodata_at=None, extra=0):
    v = (np.arange(n * n, dtype=np.int64) % 32768).astype(">i2")
    if nodata_at is not None:
        v[nodata_at] = -32768
    return v.tobytes() + b"\x00" * extra


@pytest.fixture()
def tiles(tmp_path):
    d = tmp_path / "dem3"
    d.mkdir()
    (d / "N10E020.hgt").write_bytes(tile_bytes(3, nodata_at=4))
    (d / "s10w020.hgt").write_bytes(tile_bytes(3))
    (d / "N02E002.hgt").write_bytes(tile_bytes(4))  # larger than a tile: its rows have another stride
    (d / "foo.hgt").write_bytes(tile_bytes(3))  # bad name
    (d / "N01E001.hgt").write_bytes(b"\x00" * 10)  # too small
    return d


def test_decode_tiles_small(spark, tiles):
    cells = decode_tiles(spark, str(tiles), samples=3)
    rows = {(r.tile, r.x, r.y): r for r in cells.collect()}
    assert len(rows) == 18
    c = rows[("N10E020", 0, 0)]  # north-west cell: value index 0
    assert c.height == 0 and c.lat_min == pytest.approx(11.0 - 0.25) and c.lon_min == pytest.approx(20.0 - 0.25)
    assert rows[("N10E020", 1, 1)].height == -32768  # no-data passes unchanged
    assert rows[("N10E020", 2, 1)].height == 5  # row-major: y*n + x
    s = rows[("S10W020", 0, 2)]  # south row of a south-west tile: sign on the sum
    assert s.lat_max == pytest.approx(-10.0 + 0.25) and s.lon_max == pytest.approx(-20.0 + 0.25)
    sw = {(r.x, r.y): r for r in decode_tiles(spark, str(tiles), samples=3, convention="sw_corner").collect() if r.tile == "S10W020"}
    assert sw[(0, 2)].lat_min == pytest.approx(-10.0 - 0.25) and sw[(0, 0)].lat_min == pytest.approx(-9.0 - 0.25)
    rej = {r.fname: r.reason for r in tile_rejects(tile_files(spark, str(tiles)), samples=3).collect()}
    assert rej == {"foo.hgt": "bad name", "N01E001.hgt": "too small", "N02E002.hgt": "too large"}


def test_decode_full_size_tile(spark, tmp_path):
    d = tmp_path / "full"
    d.mkdir()
    (d / "N10E020.hgt").write_bytes(tile_bytes(1201))
    cells = decode_tiles(spark, str(d))
    assert cells.count() == 1201 * 1201
    c = cells.where((F.col("x") == 0) & (F.col("y") == 0)).collect()[0]
    assert c.lat_min == pytest.approx(11.0 - 1 / 2400) and c.lon_max == pytest.approx(20.0 + 1 / 2400)


def test_incremental_reruns(spark, tiles, mirror, tmp_path):
    out, ck = str(tmp_path / "cells"), str(tmp_path / "ck")
    assert convert_new_tiles(spark, str(tiles), out, ck, samples=3) == 5  # all five files read
    assert spark.read.parquet(out).count() == 18
    assert convert_new_tiles(spark, str(tiles), out, ck, samples=3) == 0  # nothing new
    (tiles / "N20E030.hgt").write_bytes(tile_bytes(3))
    assert convert_new_tiles(spark, str(tiles), out, ck, samples=3) == 1
    assert spark.read.parquet(out).count() == 27
    tout, tck = str(tmp_path / "texts"), str(tmp_path / "tck")
    assert sideload_new_texts(spark, str(mirror), tout, checkpoint=tck) == 2
    (mirror / "bc9_djvu.txt").write_text("new")
    assert sideload_new_texts(spark, str(mirror), tout, checkpoint=tck) == 1
    assert {r.barcode for r in spark.read.parquet(tout).collect()} == {"bc1", "bc3", "bc9"}


def test_incremental_count_over_many_batches(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for i in range(130):
        (d / f"N{i % 60:02d}E{i:03d}.hgt").write_bytes(tile_bytes(3))
    out, ck = str(tmp_path / "cells"), str(tmp_path / "ck")
    assert convert_new_tiles(spark, str(d), out, ck, samples=3, max_files_per_batch=1) == 130
    assert spark.read.parquet(out).count() == 130 * 9
