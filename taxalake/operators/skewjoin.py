"""Inner joins whose key is very uneven on either side.

A key with a third of the rows is one task in a shuffle join, and its pairs are made by that
task alone. Here the keys above a share of the rows are found first, by a count-min sketch
(counts of a few hashed buckets, combined map-side) and an exact count of the keys that all
their buckets leave possible. Rows of such a key are dealt over a grid: with ``a`` slices
of its left rows and ``b`` of its right rows, a left row goes to the ``b`` cells of its slice and
a right row to ``a``, so that each pair meets in one cell. All other rows keep one cell, and
everything is one sort-merge join on (key, cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, DEPTH = 1 << 16, 2
#: A key is heavy from this share of its side's rows on; so at most 1 / SHARE keys a side are.
SHARE = 1 / 1000
#: Fewer rows than this are no burden to a task, whatever their share.
LEAST_ROWS = 10_000


def _buckets(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), key), F.lit(WIDTH)) for seed in range(DEPTH)]


def heavy_keys(df: DataFrame, key: str, share: float = SHARE, least_rows: int = LEAST_ROWS) -> DataFrame:
    """``key`` and ``n`` of the keys that hold at least ``share`` of the rows that have a key, and at least
    ``least_rows``: at most 1 / ``share`` rows, exact."""
    keyed = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"))
    cells = F.array(*[F.struct(F.lit(i).alias("line"), b.alias("bucket")) for i, b in enumerate(_buckets(F.col("key")))])
    sketch = keyed.select(F.explode(cells).alias("c")).groupBy("c.line", "c.bucket").agg(F.count(F.lit(1)).alias("n"))
    total = sketch.where("line = 0").agg(F.sum("n")).first()[0] or 0
    least = max(least_rows, share * total)
    found = sketch.where(F.col("n") >= least).collect()  # at most 1 / share a line
    may = F.lit(bool(found))
    for i, b in enumerate(_buckets(F.col("key"))):
        may = may & b.isin([r["bucket"] for r in found if r["line"] == i])
    exact = keyed.where(may).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") >= least).withColumnRenamed("key", key)


def _slice(n: Column) -> Column:
    """The slice of a row: by its place in its task, whatever the row holds."""
    return F.pmod(F.monotonically_increasing_id(), n)


def heavy_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, share: float = SHARE, tasks: int = 200,
               least_rows: int = LEAST_ROWS) -> DataFrame:
    """All pairs of rows with equal keys (null keys have none): the columns of ``left``, then those of
    ``right``, which must have other names. A cell has about heavy rows / ``tasks`` rows of each side.

    Both sides are read three times and their rows are dealt by their place in them: give tables
    or written stages, whose rows stay where they are when a task is run again."""
    sides = []
    for df, key in ((left, left_key), (right, right_key)):
        per = heavy_keys(df, key, share, least_rows).select(F.col(key).alias("_key"), F.col("n").alias("_n"))
        rows = per.agg(F.sum("_n")).first()[0] or 0
        sides.append((per, max(1, int(max(rows, 1) // tasks))))
    (l_heavy, l_size), (r_heavy, r_size) = sides
    cells = l_heavy.withColumnRenamed("_n", "_l").join(r_heavy.withColumnRenamed("_n", "_r"), "_key", "full")
    count = lambda c, size: F.ceil(F.coalesce(c, F.lit(1)) / size).cast("long")
    cells = cells.select("_key", count(F.col("_l"), l_size).alias("_a"), count(F.col("_r"), r_size).alias("_b"))
    grid = {r["_key"]: (r["_a"], r["_b"]) for r in cells.collect()}  # at most 2 / share keys
    if not grid:
        return left.join(right.hint("merge"), F.col(left_key) == F.col(right_key))
    spark = left.sparkSession
    small = spark.createDataFrame([(k, a, b) for k, (a, b) in grid.items()], f"_key {left.schema[left_key].dataType.simpleString()}, _a long, _b long")

    def dealt(df: DataFrame, key: str, own: str, other: str, cell) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).join(F.broadcast(small), F.col(key) == F.col("_key"), "left").drop("_key")
        a, b = (F.coalesce(c, F.lit(1).cast("long")) for c in (own, other))
        rows = rows.withColumn("_own", _slice(a)).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), b - 1)))
        return rows.withColumn("_cell", cell(F.col("_own"), F.col("_copy"), F.coalesce("_b", F.lit(1).cast("long")))).drop("_a", "_b", "_own", "_copy")

    lefts = dealt(left, left_key, "_a", "_b", lambda own, copy, b: own * b + copy)
    rights = dealt(right, right_key, "_b", "_a", lambda own, copy, b: copy * b + own).withColumnRenamed("_cell", "_other")
    joined = lefts.join(rights.hint("merge"), (F.col(left_key) == F.col(right_key)) & (F.col("_cell") == F.col("_other")))
    return joined.drop("_cell", "_other")
