"""Idempotent reruns as file streams.

The reference skips a tile or a text file whose output already exists, so a
rerun only converts new input. A Structured Streaming file source gives the
same rule with a guarantee: its checkpoint records every file already
processed, the Parquet file sink commits each batch exactly once, and
``trigger(availableNow=True)`` processes everything new and then stops, so
the job runs like a batch job and can be scheduled the same way. A lost
executor or a killed run resumes from the checkpoint without duplicates.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.functions.geometry import SAMPLES, parse_tile_name
from taxalake.session import checkpoint_root
from taxalake.sources.raster import CELL_SCHEMA, _decoder


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _stable_name(*parts: str) -> str:
    """Same input, same checkpoint folder, in every process."""
    return hashlib.md5("\x00".join(parts).encode()).hexdigest()[:16]


def _run(df: DataFrame, out: str, checkpoint: str, partition_by=()) -> int:
    w = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        w = w.partitionBy(*partition_by)
    # keep every batch's progress for the count (Spark keeps the last 100 by
    # default and reads the setting at each update), restored afterwards
    key = "spark.sql.streaming.numRecentProgressUpdates"
    spark = df.sparkSession
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1000000")
    try:
        q = w.start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
        return int(sum(p.get("numInputRows", 0) for p in q.recentProgress))
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_tiles_stream(
    spark: SparkSession, src: str, samples: int = SAMPLES, convention: str = "reference", glob: str = "*.hgt",
    max_files_per_batch: int = 64, chunk_rows: int = 200_000,
) -> DataFrame:
    """Streaming cells of tiles that have not been processed yet."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(src)
        .select(F.regexp_extract("path", r"([^/]*)$", 1).alias("fname"), "content")
    )
    parsed = parse_tile_name(files, "fname").select(
        "tile", "ok", "lat_sign", "base_lat", "lon_sign", "base_lon", "content"
    )
    return parsed.mapInPandas(_decoder(samples, convention, chunk_rows), CELL_SCHEMA)


def convert_new_tiles(
    spark: SparkSession, src: str, out: str, checkpoint: str | None = None, **kw
) -> int:
    """Decode tiles not converted before and append their cells to ``out``.

    Returns the number of tile files read in this run (0 when nothing is new).
    """
    ckpt = checkpoint or f"{checkpoint_root(spark)}/streams/tiles-{_stable_name(src, out)}"
    return _run(new_tiles_stream(spark, src, **kw), out, ckpt)


def sideload_new_texts(
    spark: SparkSession, src: str, out: str, suffix: str = "_djvu.txt", key: str = "barcode",
    checkpoint: str | None = None, max_files_per_batch: int = 1000,
) -> int:
    """Read text files not seen before as (key, text) rows and append them to
    ``out``. Returns the number of files read in this run."""
    esc = suffix.replace(".", r"\.")
    texts = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", "*" + suffix)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(src)
        .select(
            F.regexp_extract(F.regexp_extract("path", r"([^/]*)$", 1), f"^(.*){esc}$", 1).alias(key),
            F.col("content").cast("string").alias("text"),
        )
    )
    ckpt = checkpoint or f"{checkpoint_root(spark)}/streams/texts-{_stable_name(src, out)}"
    return _run(texts, out, ckpt)
