"""Quoted dumps read in splits.

A line break inside quotes does not end a record, so a reader that takes a file as a whole
(``multiLine``) is one task a file. Here a dump is read as lines, in splits. Whether a line
begins inside quotes depends on all lines before it, but each line only maps one state to
another (outside or inside quotes), and such maps compose: a map that sends both states to one
forgets what was before, the others keep it or swap it. So the state before a line is the last
forgetful map's result, swapped as often as lines after it swap. A split is cut into chunks of
a set number of lines, which are dealt over tasks by the files' sizes, so what a task holds does not
grow with its split: that takes a running sum in each chunk, and one row a chunk to carry the state
from chunk to chunk. Lines that are not a whole record are then joined to records, and each record
is parsed by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FILE, _BLOCK, _CHUNK, _AT = "_file", "_block", "_chunk", "_at"
_PART = [_FILE, _BLOCK, _CHUNK]  # lines that follow one another
CHUNK_BITS = 14  # a chunk holds up to 2 ** 14 lines
TASK_BYTES, MOST_TASKS = 16 << 20, 20_000  # of text in a task after a shuffle; tasks of a shuffle, beyond which each gets more


def _ends_inside(value: Column, sep: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes, if it begins outside and if it begins inside. Possessive
    quantifiers only: a long line neither backtracks nor recurses."""
    s = re.escape(sep)
    body = '[^"]*+(?:""[^"]*+)*+'  # a doubled quote is text
    whole = f'(?:"{body}"[^{s}]*+|[^{s}"][^{s}]*+|)'
    open_ = f'(?:{whole}{s})*+"{body}$'
    plain = ~value.contains('"')
    outside = F.when(plain, F.lit(0)).otherwise(value.rlike(f"^{open_}").cast("int"))
    inside = F.when(plain, F.lit(1)).otherwise(value.rlike(f'^{body}(?:$|"[^{s}]*+{s}{open_})').cast("int"))
    return outside, inside


def _running(rows: DataFrame, by: list[str], order: list[str], outside: str, inside: str) -> DataFrame:
    """``rows`` with ``_fixed`` (state before the row, less the swaps, if a row before it fixes it) and
    ``_swaps`` (parity of the swaps before it), in the groups ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    fixes, swaps = F.col(outside) == F.col(inside), ((F.col(outside) == 1) & (F.col(inside) == 0)).cast("long")
    rows = rows.withColumn("_upto", F.sum(swaps).over(upto) % 2)
    mark = F.when(fixes, F.col(outside).bitwiseXOR(F.col("_upto").cast("int")))
    return rows.withColumns(
        {"_fixed": F.last(mark, ignorenulls=True).over(before), "_swaps": F.coalesce(F.lag("_upto").over(w), F.lit(0)).cast("int")}
    )


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_AT),
    )
    outside, inside = _ends_inside(F.col("value"), sep)
    return lines.withColumns({_CHUNK: F.shiftright(_AT, CHUNK_BITS), "_o": outside, "_i": inside})


def _tasks(spark: SparkSession, path: str) -> int:
    """Tasks of a shuffle of all lines, by the files' sizes. A line's position takes several times its text,
    so stored bytes as measured after a shuffle say little about the memory that a task needs."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return min(max(-(-size // TASK_BYTES), 2), MOST_TASKS)  # never all lines in one task


def read_records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``record`` (its text with line breaks), ``_file`` and ``_row`` (from 1) of every record of the files
    in ``path``, also of blank ones. The end of a file ends an open quote."""
    tasks = _tasks(spark, path)
    lines = _lines(spark, path, sep).repartition(tasks, *_PART)
    placed = _running(lines, _PART, [_AT], "_o", "_i")
    state = lambda entry: F.coalesce("_fixed", entry).bitwiseXOR(F.col("_swaps"))
    after = lambda entry: F.when(state(entry) == 0, F.col("_o")).otherwise(F.col("_i"))
    zero, one = F.lit(0), F.lit(1)
    # a chunk as a whole maps states like a line does; and how many records begin in it (the lines'
    # text is counted so that this reads the shuffle of the lines, not the files once more)
    chunks = placed.groupBy(*_PART).agg(
        F.max_by(after(zero), _AT).alias("_bo"), F.max_by(after(one), _AT).alias("_bi"),
        F.count_if((state(zero) == 0) & F.col("value").isNotNull()).alias("_n0"),
        F.count_if((state(one) == 0) & F.col("value").isNotNull()).alias("_n1"),
    )
    chunks = _running(chunks, [_FILE], [_BLOCK, _CHUNK], "_bo", "_bi").withColumn("_entry", state(zero))
    before = Window.partitionBy(_FILE).orderBy(_BLOCK, _CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("_entry") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    chunks = chunks.select(*_PART, "_entry", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("_first"))

    rows = placed.join(chunks, _PART)
    first = (state(F.col("_entry")) == 0).cast("int")
    upto = Window.partitionBy(*_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_start", first).withColumn("_row", F.col("_first") + F.sum("_start").over(upto))
    alone = (F.col("_start") == 1) & (after(F.col("_entry")) == 0)
    single = rows.where(alone).select(F.col("value").alias("record"), _FILE, "_row")
    parts = rows.where(~alone).repartition(tasks, _FILE, "_row").groupBy(_FILE, "_row").agg(F.sort_array(F.collect_list(F.struct(_BLOCK, _AT, "value"))).alias("lines"))
    joined = parts.select(F.array_join("lines.value", "\n").alias("record"), _FILE, "_row")
    return single.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_quoted_splits(spark: SparkSession, path: str, schema, corrupt: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """The columns of ``schema`` (text columns and ``corrupt``, which holds a record whose number of
    fields is another), ``_file`` and ``_row`` (the record's number in its file, the header's included)."""
    records = read_records(spark, path, sep)
    if header:
        records = records.where("_row > 1")
    else:
        records = records.withColumn("record", F.when(F.col("_row") == 1, F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record")))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    ddl = ", ".join(f"`{f.name}` string" for f in schema.fields)
    parsed = records.where("record <> ''").select(F.from_csv("record", ddl, options).alias("_r"), _FILE, F.col("_row").cast("long").alias("_row"))
    return parsed.select(*[F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields], _FILE, "_row")
