"""Row numbers of a total order, or of an order within groups, computed by all tasks.

``row_number`` over a window without partitions sends the table to one task, and over a
group's partition the whole group. Here rows are dealt over ranges of the order (an even
sample of the keys decides the ranges), each task sorts and numbers its own range, and
the numbers of the ranges before it are added: one count a range, or one a group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taxalake.session import scratch_path

#: ``monotonically_increasing_id`` keeps the partition above so many bits.
ROW_BITS = 33


def _fresh(taken: list[str], name: str) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, order, by=(), name: str = "position", first: int = 1, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the row's number (from ``first``) in the order of ``order`` (columns or
    sort expressions), within the rows that are equal in the columns ``by`` if there are any.

    Nulls come where the sort expressions put them (Spark: first when ascending). Rows that are
    equal in ``by`` and ``order`` are numbered in any order, once and for all: the sorted rows are
    written to the shared scratch folder before they are numbered. Give enough columns in
    ``order`` to tell rows apart: only then can a hot key be dealt over several ranges.
    Nulls in ``by`` are a group. An empty table stays empty.

    What reaches the driver is one count a range (without ``by``).
    """
    spark, at = df.sparkSession, _fresh([*df.columns, name], "_at")
    by = list(by)
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    path = scratch_path(spark, "numbered")
    dealt.sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright(F.col(at), ROW_BITS)
    if not by:
        counts = dict(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        before, total = [0] * (max(counts, default=-1) + 2), first
        for p in range(len(before)):
            before[p] = total - (p << ROW_BITS)
            total += counts.get(p, 0)
        return rows.withColumn(name, F.lit(before).cast("array<long>")[part.cast("int")] + F.col(at)).drop(at)
    return _within(rows, by, at, part, name, first)


def running_total(df: DataFrame, value: str, order, by=(), name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before this one in the order of ``order``,
    within the groups ``by``. Ranges, ties and nulls as in ``numbered``; null values count as 0."""
    spark, at = df.sparkSession, _fresh([*df.columns, name], "_at")
    by = list(by)
    keys = [F.col(c) if isinstance(c, str) else c for c in [*by, *order]]
    path = scratch_path(spark, "totals")
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright(F.col(at), ROW_BITS))
    here = Window.partitionBy("_part", *by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    own = [f"_by{i}" for i in range(len(by))]
    sums = spark.read.parquet(path).groupBy(*[F.col(c).alias(k) for c, k in zip(by, own)], F.shiftright(F.col(at), ROW_BITS).alias("_range"))
    upto = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.agg(F.sum(value).alias("_sum")).select(*own, "_range", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_shift"))
    on = rows["_part"] == sums["_range"]
    for c, k in zip(by, own):
        on = on & rows[c].eqNullSafe(sums[k])
    return rows.join(sums, on).withColumn(name, F.col("_here") + F.col("_shift")).drop(at, "_part", "_here", *own, "_range", "_shift")


def chunked_lists(df: DataFrame, key: list[str], value: str, size: int, count: str | None = None, chunk: str = "chunk", out: str = "values") -> DataFrame:
    """The values of each key in order, duplicates kept, in lists of at most ``size``: ``key``, ``chunk``
    (from 0) and ``out``. ``count`` names a column that says how often a row's value stands there.

    A key with very many values is many rows, none of which grows; equal values are summed before they
    are placed. Null values come first."""
    n = F.col(count) if count else F.lit(1)
    sums = df.groupBy(*key, value).agg(F.sum(n).cast("long").alias("_n"))
    placed = running_total(sums, "_n", [F.col(value).asc_nulls_first()], by=key, name="_first")
    end = F.col("_first") + F.col("_n")
    chunks = F.sequence(F.floor(F.col("_first") / size), F.floor((end - 1) / size))
    pieces = placed.withColumn(chunk, F.explode(chunks))
    own = F.least(end, (F.col(chunk) + 1) * size) - F.greatest(F.col("_first"), F.col(chunk) * size)
    pieces = pieces.select(*key, chunk, F.struct("_first", F.col(value).alias("v"), own.cast("int").alias("n")).alias("_piece"))
    lists = pieces.groupBy(*key, chunk).agg(F.sort_array(F.collect_list("_piece")).alias("_pieces"))
    return lists.select(*key, chunk, F.flatten(F.transform("_pieces", lambda p: F.array_repeat(p["v"], p["n"]))).alias(out))


def _within(rows: DataFrame, by: list[str], at: str, part: Column, name: str, first: int) -> DataFrame:
    own = [f"_by{i}" for i in range(len(by))]
    counts = rows.groupBy(*[F.col(c).alias(k) for c, k in zip(by, own)], part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(at).alias("_least")
    )
    # one row for each range that a group reaches into
    upto = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_least") + first).alias("_shift")
    starts = counts.select(*own, "_part", shift)
    on = part == starts["_part"]
    for c, k in zip(by, own):
        on = on & rows[c].eqNullSafe(starts[k])
    return rows.join(starts, on).withColumn(name, F.col(at) + F.col("_shift")).drop(at, *own, "_part", "_shift")
