"""Text sources: lines, and whole files keyed by their name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.sources.listed import read_files


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines (column ``value``); bz2 files are split and read in parallel."""
    return spark.read.text(path)


def read_texts(
    spark: SparkSession,
    path: str,
    suffix: str = "_djvu.txt",
    key: str = "barcode",
    null_on_bad_utf8: bool = False,
) -> DataFrame:
    """One row per file: (key, text), key taken from the name ``<key><suffix>``.

    ``path`` is a folder or glob; only files ending in ``suffix`` are read,
    each whole (a file is one task's unit, files spread over tasks by size).
    Bytes that are not UTF-8 become U+FFFD; ``null_on_bad_utf8=True`` gives
    null text for such files instead, as the reference's reader does.
    An empty file is empty text (``sources.listed`` reads those too).
    """
    files = read_files(spark, path, suffix).select(F.col("name").alias("_file"), F.col("content").cast("string").alias("_t"))
    text = F.try_validate_utf8("_t") if null_on_bad_utf8 else F.col("_t")
    esc = suffix.replace(".", r"\.")
    return files.select(F.regexp_extract("_file", f"^(.*){esc}$", 1).alias(key), text.alias("text"))
