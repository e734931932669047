"""Elevation tile names and cell geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
# Tile name pattern, matched at the start of the upper-cased base name.
TILE_NAME_PATTERN = r"^([NS])([0-9]+)([EW])([0-9]+)"
# Samples per tile side of a 3 arc-second tile.
SAMPLES = 1201


def tile_base_name(fname: Column) -> Column:
    """Upper-cased file name without its last four characters (the extension)."""
    base = F.regexp_extract(fname, r"([^/]*)$", 1)
    return F.upper(F.substring(base, F.lit(1), F.greatest(F.length(base) - 4, F.lit(0))))


def parse_tile_name(df: DataFrame, fname: str = "fname") -> DataFrame:
    """Add tile, ok, lat_sign, base_lat, lon_sign, base_lon, reason."""
    base = tile_base_name(F.col(fname))
    ok = base.rlike(TILE_NAME_PATTERN)
    g = lambda i: F.regexp_extract(base, TILE_NAME_PATTERN, i)
    return df.select(
        "*",
        base.alias("tile"),
        ok.alias("ok"),
        F.when(ok, F.when(g(1) == "N", 1).otherwise(-1)).alias("lat_sign"),
        F.when(ok, g(2).try_cast("int")).alias("base_lat"),
        F.when(ok, F.when(g(3) == "E", 1).otherwise(-1)).alias("lon_sign"),
        F.when(ok, g(4).try_cast("int")).alias("base_lon"),
        F.when(~ok, F.lit("bad name")).alias("reason"),
    )


def cell_geometry(
    x: Column,
    y: Column,
    lat_sign: Column,
    base_lat: Column,
    lon_sign: Column,
    base_lon: Column,
    samples: int = SAMPLES,
    convention: str = "reference",
) -> list[Column]:
    """lat_min, lat_max, lon_min, lon_max of cell (x, y); y = 0 is the north row.

    ``'reference'``: lat = sign * (base + (n-1-y)/(n-1)) and lon = sign * (base +
    x/(n-1)), so south/west tiles grow away from the equator. ``'sw_corner'``:
    the name is the south-west corner, lat = sign*base + (n-1-y)/(n-1).
    """
    step = float(samples - 1)
    half = 1.0 / (2 * step)
    dy = (F.lit(samples - 1) - y).cast("double") / step
    dx = x.cast("double") / step
    if convention == "reference":
        lat = lat_sign * (base_lat + dy)
        lon = lon_sign * (base_lon + dx)
    elif convention == "sw_corner":
        lat = lat_sign * base_lat + dy
        lon = lon_sign * base_lon + dx
    else:
        raise ValueError(convention)
    return [
        (lat - half).alias("lat_min"),
        (lat + half).alias("lat_max"),
        (lon - half).alias("lon_min"),
        (lon + half).alias("lon_max"),
    ]


def grid_cells(
    grids: DataFrame,
    samples: int,
    values: str = "values",
    key: str = "grid_id",
    convention: str = "reference",
) -> DataFrame:
    """Explode a row-major ``samples x samples`` value array into cells.

    Input columns: key, lat_sign, base_lat, lon_sign, base_lon, values.
    Output: key, x, y, lat_min, lat_max, lon_min, lon_max, height. Values
    pass unchanged (no-data markers too).
    """
    e = grids.select(key, "lat_sign", "base_lat", "lon_sign", "base_lon", F.posexplode(values).alias("pos", "height"))
    x = (F.col("pos") % samples).cast("int")
    y = F.floor(F.col("pos") / samples).cast("int")
    e = e.withColumn("x", x).withColumn("y", y)
    geo = cell_geometry(
        F.col("x"), F.col("y"), F.col("lat_sign"), F.col("base_lat"), F.col("lon_sign"), F.col("base_lon"), samples, convention
    )
    return e.select(key, "x", "y", *geo, "height")
