"""Parquet snapshots, editions, delimited exports, materialized stages."""

from __future__ import annotations

import datetime as _dt
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.operators.topk import first_rows, top_n

# Fixed values that must equal the reference's for equal results.
STAMP_FORMAT = "%Y%m%dT%H%M%S"
EDITION_SIZES = {"100k": 100_000, "1M": 1_000_000}


def stamp_of(when: _dt.datetime) -> str:
    """Snapshot stamp ``YYYYMMDDTHHMMSS`` of a time the caller chose."""
    return when.strftime(STAMP_FORMAT)


def snapshot_name(base: str, name: str, stamp: str, edition: str | None = None) -> str:
    """``<base>/<name>-<stamp>[-<edition>].parquet``."""
    tail = f"-{edition}" if edition else ""
    return f"{base.rstrip('/')}/{name}-{stamp}{tail}.parquet"


def write_snapshot(df: DataFrame, path: str, overwrite: bool = False, partition_by=(), rebalance: bool = True) -> str:
    """Write Parquet; without ``overwrite`` an existing output fails the job
    (the guard for reruns).

    With ``partition_by`` the rows are rebalanced by the partition columns:
    the sizes measured at run time decide how many tasks (and files) a value
    gets, so a small one is one file and a value with a large share of the
    rows is split. ``rebalance=False``: each task writes its own files.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_editions(
    df: DataFrame,
    base: str,
    name: str,
    stamp: str,
    sizes: dict[str, int] = EDITION_SIZES,
    order: list[str] | None = None,
    overwrite: bool = False,
) -> dict[str, str]:
    """Full snapshot plus ``limit(n)`` editions.

    The full data is written once; the editions are read back from that
    snapshot, so the source is scanned once. Without ``order`` an edition is
    any ``n`` rows (as the reference); with ``order`` it is the first ``n`` by
    that key. Neither funnels the table into one task (see ``operators.topk``).
    """
    spark = df.sparkSession
    full = write_snapshot(df, snapshot_name(base, name, stamp), overwrite)
    written = {"all": full}
    src = spark.read.parquet(full)
    for label, n in sizes.items():
        part = top_n(src, list(order), n) if order else first_rows(_leading_files(spark, src, n), n)
        written[label] = write_snapshot(part, snapshot_name(base, name, stamp, label), overwrite)
    return written


def _leading_files(spark: SparkSession, src: DataFrame, n: int) -> DataFrame:
    """The first files of a snapshot that hold ``n`` rows between them. Counting rows by file
    reads footers only; the rows that are read later are about ``n``, not the snapshot's."""
    sizes = src.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")).collect()
    chosen, rows = [], 0
    for r in sorted(sizes):
        chosen.append(r.path)
        rows += r.n
        if rows >= n:
            break
    return spark.read.schema(src.schema).parquet(*chosen) if chosen else src


def edition_counts(spark: SparkSession, written: dict[str, str]) -> DataFrame:
    """Rows per written edition: (edition, n_rows)."""
    parts = [
        spark.read.parquet(p).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
            F.lit(label).alias("edition"), "n_rows"
        )
        for label, p in written.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot_path(base: str, source: str, date: str, name: str) -> str:
    """``<base>/source=<source>/date=<date>/<name>``."""
    return f"{base.rstrip('/')}/source={source}/date={date}/{name}"


def latest_snapshot(df: DataFrame, source: str) -> DataFrame:
    """Rows of the newest ``date`` partition of one source.

    ``df`` is a table partitioned by ``source``/``date``; both filters hit
    partition columns, so only the chosen folder is read; the newest date is
    a scalar subquery over a partition column (no data columns are read).
    """
    newest = df.where(F.col("source") == source).agg(F.max("date").alias("_d"))
    return df.where((F.col("source") == source) & (F.col("date") == newest.scalar()))


def newest_partition(spark: SparkSession, base: str, source: str) -> DataFrame:
    """Rows of the newest ``date`` folder of one ``source`` of a ``source=/date=`` table.

    The dates come from one listing of the source's folder, so the plan has a single scan, of the
    chosen folder; dates are compared as text (``YYYYMMDD`` or ISO). A source without a
    folder gives no rows of the table's schema.
    """
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/source={names.escapePathName(source)}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    dates = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    dates = sorted(d for d in dates if d.startswith("date="))
    if not dates:
        return spark.read.parquet(base).where(F.lit(False))
    return spark.read.option("basePath", base).parquet(f"{path.toString()}/{dates[-1]}")


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.DISK_ONLY):
    """A stage that several results reuse, kept by Spark's cache while the block runs::

        with persisted(links) as links:
            ...

    It is computed once, when first used, and released at the end; partitions of a lost executor are
    computed anew."""
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


def export_delimited(
    df: DataFrame,
    path: str,
    sep: str = "\t",
    header: bool = True,
    single_file: bool = False,
    sort_by: list[str] | None = None,
) -> str:
    """Delimited text export (overwrite). Note: an empty string and a null are
    both read back as null.

    ``single_file=True`` writes one file (everything passes through one task:
    small reports only). For a large sorted export leave it off: ``sort_by``
    range-partitions and sorts (other columns break ties), and the part files
    concatenate in order.
    """
    out = df
    if sort_by:
        # the other columns break ties, so range partitions can split a key
        # that holds many rows instead of giving it to one writer task
        ties = [c for c in df.columns if c not in sort_by]
        out = out.orderBy(*sort_by, *ties)
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)
    return path


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write a stage and read it back (cuts lineage; later steps read Parquet)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
