"""Fetch manifests, idempotent reruns, directory listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# the files fetched per item key, and the default source address.
FILE_SUFFIXES = ("_djvu.txt", "_files.xml")
SOURCE_URL = "http://archive.org/download"


def file_name(key, suffix) -> F.Column:
    """``<key><suffix>`` (the mirror file of a key)."""
    return F.concat(key, suffix)


def missing_manifest(
    keys: DataFrame,
    present: DataFrame | None,
    key: str = "barcode",
    suffixes=FILE_SUFFIXES,
    source_url: str = SOURCE_URL,
    mirror_dir: str = "data/mirror",
) -> DataFrame:
    """Every key x every suffix, less the files already present.

    ``present`` has one column ``file`` (mirror file names). Keys that are
    null give a row with ``problem='null key'`` and no names. The suffix list
    is a literal array exploded per key (no cross join); the present files
    are removed with an anti join on the file name.
    """
    k = F.col(key)
    specs = keys.select(k.alias("key"), F.explode(F.array(*[F.lit(s) for s in suffixes])).alias("suffix"))
    specs = specs.select(
        "key",
        "suffix",
        file_name(F.col("key"), F.col("suffix")).alias("file"),
        F.concat_ws("/", F.lit(mirror_dir), file_name(F.col("key"), F.col("suffix"))).alias("local_fn"),
        F.concat(F.concat_ws("/", F.lit(source_url), F.col("key"), F.col("key")), F.col("suffix")).alias("remote_fn"),
        F.when(F.col("key").isNull(), F.lit("null key")).alias("problem"),
    )
    if present is not None:
        # null keys give null names that match nothing: keep them out of the
        # shuffle (one task would get them all) and add them back
        named = specs.where(F.col("file").isNotNull())
        specs = named.join(present.select("file").distinct(), "file", "left_anti").unionByName(
            specs.where(F.col("file").isNull())
        )
    return specs


def only_new(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Units whose key has no output yet (idempotent rerun). Units without a
    key are never done; they bypass the anti join's shuffle."""
    k = F.col(key)
    keyed = units.where(k.isNotNull()).join(done.select(key).where(k.isNotNull()).distinct(), key, "left_anti")
    return keyed.unionByName(units.where(k.isNull()))


def listing_links(
    pages: DataFrame,
    html: str = "html",
    line_sep: str = "\n",
    must_contain=("bytes)", ".seq.gz"),
    must_start: str | None = None,
    field_sep: str = '"',
    field_index: int = 1,
    keep=("page_id",),
) -> DataFrame:
    """Links from an HTML index: split into lines, keep lines holding every
    marker, take field ``field_index`` (0-based) of the line split on ``field_sep``.
    """
    lines = pages.select(*keep, F.explode(F.split(F.col(html), _re_quote(line_sep), -1)).alias("line"))
    cond = F.lit(True)
    for m in must_contain:
        cond = cond & F.col("line").contains(m)
    if must_start is not None:
        cond = cond & F.col("line").startswith(must_start)
    parts = F.split(F.col("line"), _re_quote(field_sep), -1)
    # awk prints an empty field when the line has fewer fields
    return lines.where(cond).select(*keep, F.coalesce(F.get(parts, field_index), F.lit("")).alias("link"))


def _re_quote(s: str) -> str:
    import re

    return re.escape(s)
