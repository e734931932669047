"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.session import checkpoint_root, scratch_path

#: Words are runs of other characters than these six (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, through Spark's reader (the path may be in any store)."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


#: Makes Spark delete the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that later
    jobs neither recompute it nor depend on an executor that may be lost. The shuffle
    files that it took are deleted at once, not when the driver collects its garbage."""
    checkpoint_root(df.sparkSession)
    with _cleaned(df.sparkSession):
        return df.select("*").checkpoint()  # the setting counts for DataFrames made under it


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def plain_key(c: Column) -> dict[str, Column]:
    """Two columns that are equal exactly if the (integer) ids are, a null id equal to a null id."""
    return {"k": F.coalesce(c.cast("long"), F.lit(0).cast("long")), "z": c.isNull()}


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder, and read again; its shuffle files are
    deleted as by ``durable``. Takes less disk than that where columns compress."""
    path = scratch_path(df.sparkSession, name)
    with _cleaned(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key with more than such a part of the rows is joined apart.
HOT = 1000


def spread_join(rows: DataFrame, side: DataFrame, key: str, weight: str, most: int = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``side``, a written table of one row for each ``key`` and, in ``weight``, the number
    of ``rows`` that have it. Keys with more than a ``most``-th of all joined rows, so fewer than ``most`` keys, are sent
    to every task; their rows are dealt by their whole content from then on, all others by the key."""
    total = side.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * most > F.lit(total).cast("decimal(38,0)")
    given = [c for c in side.columns if c not in (key, weight)]
    at, by, other = (fresh(rows, c) for c in ("_hot", "_salt", "_other"))
    near = side.where(hot).select(key, F.struct(*given).alias(at))
    far = side.where(~hot).select(key, F.lit(0).cast("long").alias(by), F.struct(*given).alias(other))
    marked = rows.join(F.broadcast(near), key, "left")
    marked = marked.withColumn(by, F.when(F.col(at).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns)))
    joined = marked.join(far, [key, by], "left").withColumn(at, F.coalesce(at, other)).where(F.col(at).isNotNull())
    return joined.select(*rows.columns, *(F.col(f"{at}.{c}").alias(c) for c in given))
