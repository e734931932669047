"""Side-load full texts onto item rows by key, and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sideload_text(items: DataFrame, texts: DataFrame, key: str = "barcode", text_key: str | None = None,
                  text: str = "text", out: str = "ocrtext") -> DataFrame:
    """Items left-joined to their text: one row per item, null text where the
    key is null, missing, or has no readable text.

    Texts are keyed uniquely (one file per key). Both sides are large at
    scale, so this is a shuffle (sort-merge) join on the key; AQE may switch
    to a broadcast only when the text side proves small at run time.
    """
    text_key = text_key or key
    t = texts.select(F.col(text_key).alias("_tkey"), F.col(text).alias(out)).where(F.col("_tkey").isNotNull())
    k = F.col(key)
    # rows without a key cannot match: they skip the shuffle instead of all
    # hashing to one task (a third of the items may lack a key)
    keyed = items.where(k.isNotNull())
    joined = keyed.join(t, keyed[key] == t["_tkey"], "left").drop("_tkey")
    unkeyed = items.where(k.isNull()).withColumn(out, F.lit(None).cast("string"))
    return joined.unionByName(unkeyed)


def text_coverage(df: DataFrame, text: str = "ocrtext") -> DataFrame:
    """Rows, and rows that have text."""
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count(text).cast("bigint").alias("n_with_text"),
    )


def hash_bucket(key, buckets: int = 1000):
    """Repeatable bucket of a key: first 8 hex digits of md5(key) mod buckets."""
    h = F.substring(F.md5(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") % buckets


def hash_sample(df: DataFrame, key: str, rate: float, buckets: int = 1000) -> DataFrame:
    """Repeatable Bernoulli-like sample: rows whose key hashes below ``rate``.
    The same key is always in or out, on any engine that has md5."""
    return df.where(hash_bucket(key, buckets) < int(round(rate * buckets)))


def bernoulli_sample(df: DataFrame, rate: float, seed: int | None = None) -> DataFrame:
    """Sample without replacement, as the reference's optional test step."""
    return df.sample(withReplacement=False, fraction=rate, seed=seed)
