"""Delimited text sources (TSV dumps with quoting, header TSV/CSV, headerless CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxalake.functions.ids import java_trim
from taxalake.sources.quoted import read_quoted_splits

CORRUPT = "_corrupt"


def string_schema(columns, corrupt: bool = False) -> T.StructType:
    fields = [T.StructField(c, T.StringType(), True) for c in columns]
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
    return T.StructType(fields)


def read_quoted_table(
    spark: SparkSession,
    path: str,
    columns,
    sep: str = "\t",
    with_row_order: bool = True,
) -> DataFrame:
    """A dump with a header (and maybe a byte-order mark), ``"`` quoting and
    fields that may hold line breaks, read in splits (``sources.quoted``).

    All columns are read as text; typing is a separate, validated step.
    A short row (unescaped line break) keeps its row with nulls and is
    flagged in ``_corrupt``. ``_file`` and ``_row`` (the record's number in its
    file, the header being 1) give the row order within the dump (``row_order``).
    Records end at a line feed, with or without a carriage return before it.
    """
    df = read_quoted_splits(spark, path, string_schema(columns, corrupt=True), CORRUPT, sep)
    return df if with_row_order else df.drop("_file", "_row")


def row_order(df: DataFrame) -> F.Column:
    """Order key of rows read by ``read_quoted_table``: (file path, position)."""
    return F.struct("_file", "_row")


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    header: bool = True,
    schema: T.StructType | str | None = None,
    trim: bool = False,
) -> DataFrame:
    """Header (or headerless) delimited text; compressed files (bz2, gz) are
    read as they are, bz2 in parallel splits.

    Without a schema every column is text (``_c0 …`` when headerless).
    ``trim=True`` trims every text column like Java's ``trim`` (tabs too).
    """
    r = spark.read.option("sep", sep).option("header", header)
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    if trim:
        df = df.select(
            *[
                java_trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                for f in df.schema.fields
            ]
        )
    return df


def read_pipe_table(spark: SparkSession, path: str) -> DataFrame:
    """A header file split on ``|`` whose fields (and header names) keep stray
    tabs: values and names are trimmed; an empty name becomes ``_c<i>``."""
    df = read_delimited(spark, path, sep="|", header=True, trim=True)
    names = [n.strip(_TRIM) or f"_c{i}" for i, n in enumerate(df.columns)]
    return df.toDF(*names)


_TRIM = "".join(chr(i) for i in range(0x21))
