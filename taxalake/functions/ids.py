"""Identifier and term expressions (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results.
# Scheme whitelist of the coverage analysis (the reference lists IF twice;
# a set has no duplicates, so it has no effect).
DEFAULT_SCHEMES = ("NCBI", "IF", "GBIF", "WORMS")
# Source prefixes of the three taxon graphs.
SOURCE_OTT = "OTT"
SOURCE_WD = "WD"
SOURCE_GLOBI = "GLOBI"
SOURCES = (SOURCE_GLOBI, SOURCE_OTT, SOURCE_WD)

# Characters Java's String.trim removes: every code point <= U+0020.
_JAVA_TRIM_CHARS = "".join(chr(i) for i in range(0x21))


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_of(c) -> Column:
    """Text before the first ``:`` (whole text when there is none); no array
    is built, unlike ``split_part``."""
    return F.substring_index(col_of(c), ":", 1)


def scala_str(c) -> Column:
    """String interpolation value: a null prints as ``null``."""
    return F.coalesce(col_of(c).cast("string"), F.lit("null"))


def prefixed(prefix: str, c) -> Column:
    """``PREFIX:value`` with null printed as ``null`` (never a null result)."""
    return F.concat(F.lit(prefix), scala_str(c))


def java_trim(c) -> Column:
    """Trim like Java's String.trim (spaces, tabs and other control chars); no regex."""
    return F.btrim(col_of(c), F.lit(_JAVA_TRIM_CHARS))


def java_split(c, sep_regex: str) -> Column:
    """Split like Java's String.split(regex): trailing empty strings are dropped.

    A text without a match gives a one-element array (also the empty text);
    a text made only of separators gives an empty array.
    """
    c = col_of(c)
    literal = len(sep_regex) == 1 and sep_regex not in ".$|()[{^?*+\\"
    # one plain separator character: strip the tail without a regex
    stripped = F.rtrim(c, F.lit(sep_regex)) if literal else F.regexp_replace(c, f"(?:{sep_regex})+$", "")
    return (
        F.when(c.isNull(), F.lit(None))
        .when((stripped == "") & (c != ""), F.array().cast("array<string>"))
        .otherwise(F.split(stripped, sep_regex, -1))
    )


def in_schemes(c, schemes=DEFAULT_SCHEMES) -> Column:
    return prefix_of(c).isin(list(dict.fromkeys(schemes)))


def key_length(key) -> Column:
    """Number of ``|`` separated parts of a composite key (Java split rules)."""
    return F.size(java_split(key, r"\|")).cast("bigint")


def prefix_repeats(ids) -> Column:
    """Distinct ids minus distinct id prefixes, over an array of ids."""
    d = F.array_distinct(col_of(ids))
    return (F.size(d) - F.size(F.array_distinct(F.transform(d, lambda x: prefix_of(x))))).cast("bigint")
