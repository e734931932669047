"""Binary elevation tiles -> one row per cell.

Each ``.hgt`` file is a ``samples x samples`` grid of big-endian int16,
north row first. Files are read with the ``binaryFile`` source (one row per
file, spread over tasks by size) and decoded with numpy inside
``mapInPandas``; cells are emitted in bounded chunks, so one task never holds
more than one tile's raster plus one chunk of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.functions.geometry import SAMPLES, parse_tile_name

CELL_SCHEMA = (
    "tile string, x int, y int, lat_min double, lat_max double, lon_min double, lon_max double, height smallint"
)


def tile_files(spark: SparkSession, path: str, glob: str = "*.hgt") -> DataFrame:
    """Tile files with parsed names: path, fname, length, content + name fields."""
    df = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("fname"), "length", "content")
    )
    return parse_tile_name(df, "fname")


def tile_rejects(files: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Files that give no cells, with the reason (bad name, or not the size of ``samples`` squared)."""
    need = 2 * samples * samples
    reason = (
        F.when(~F.col("ok"), F.lit("bad name"))
        .when(F.col("length") < need, F.lit("too small"))
        .when(F.col("length") > need, F.lit("too large"))
    )
    return files.select("fname", "tile", reason.alias("reason")).where(F.col("reason").isNotNull())


def _decoder(samples: int, convention: str, chunk_rows: int):
    n = samples
    step = float(n - 1)
    half = 1.0 / (2 * step)
    ys, xs = np.divmod(np.arange(n * n, dtype=np.int64), n)  # row-major: index = y*n + x
    dy = (n - 1 - ys) / step
    dx = xs / step

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                raw = row.content
                if not row.ok or raw is None or len(raw) != 2 * n * n:
                    continue
                elev = np.frombuffer(raw, dtype=">i2", count=n * n).astype(np.int16)
                ls, bl, os_, bo = row.lat_sign, row.base_lat, row.lon_sign, row.base_lon
                if convention == "reference":
                    lat = ls * (bl + dy)
                    lon = os_ * (bo + dx)
                else:
                    lat = ls * bl + dy
                    lon = os_ * bo + dx
                for s in range(0, n * n, chunk_rows):
                    e = slice(s, s + chunk_rows)
                    yield pd.DataFrame(
                        {
                            "tile": row.tile,
                            "x": xs[e].astype(np.int32),
                            "y": ys[e].astype(np.int32),
                            "lat_min": lat[e] - half,
                            "lat_max": lat[e] + half,
                            "lon_min": lon[e] - half,
                            "lon_max": lon[e] + half,
                            "height": elev[e],
                        }
                    )

    return decode


def decode_units(samples: int = SAMPLES, convention: str = "reference", chunk_rows: int = 200_000):
    """The work of a rerun (``sinks.files.run_new``) over tile files (unit: the file's name): their cells."""
    fields = ["tile", "ok", "lat_sign", "base_lat", "lon_sign", "base_lon", "content"]

    def work(units: DataFrame) -> DataFrame:
        parsed = parse_tile_name(units, "unit").select(*fields)
        cells = parsed.mapInPandas(_decoder(samples, convention, chunk_rows), CELL_SCHEMA)
        return cells.withColumn("unit", F.concat("tile", F.lit(".hgt")))

    return work


def decode_tiles(
    spark: SparkSession,
    path: str,
    samples: int = SAMPLES,
    convention: str = "reference",
    glob: str = "*.hgt",
    chunk_rows: int = 200_000,
) -> DataFrame:
    """All cells of all well-formed tiles under ``path``.

    Tiles of any other size than ``samples²`` values and bad names give no
    cells (see ``tile_rejects``). No-data values (-32768) pass unchanged.
    """
    files = tile_files(spark, path, glob).select(
        "tile", "ok", "lat_sign", "base_lat", "lon_sign", "base_lon", "content"
    )
    return files.mapInPandas(_decoder(samples, convention, chunk_rows), CELL_SCHEMA)
