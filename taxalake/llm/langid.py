"""Language identification by compression.

A text is encoded once per language by zstandard, each time with a raw-content
dictionary made of sample text of that language; the language that gives the
fewest bytes wins. A text whose best two sizes lie too close is rejected.

Results by case
    null text, or text without a letter: ``und``, score 0, margin 0, rejected;
    no language can be learned (no training rows): as above for every row;
    one language only: that language, score 1, margin 1;
    equal sizes: the language learned from the most texts, margin 0, rejected;
    repeated rows: each is scored; null or odd values in other columns have no effect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LETTER = r"\p{L}"
_OTHER = re.compile(r"[\W\d_]+")
#: Texts are compressed in pieces of this many bytes, so that the dictionary
#: counts as much in a long text as in a short one; all pieces are compressed.
PIECE = 4096
MATCH = 3  # shortest repeat that zstandard looks for, in bytes
RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def normal(s: str) -> bytes:
    """Lower case; every run of other characters than letters becomes one space."""
    return _OTHER.sub(" ", s.lower()).encode()


def fit(
    train: DataFrame,
    text: str = "text",
    lang: str = "lang",
    docs_per_lang: int = 400,
    chars_per_doc: int = 1000,
    dict_bytes: int = 131072,
) -> dict[str, bytes]:
    """Dictionary bytes by language, from a sample of ``train``.

    The sample is bounded: about ``docs_per_lang`` different texts of each language (all, if it
    has fewer), chosen by a hash of the text, so that every language with a text has a dictionary, at most ``chars_per_doc`` characters from the middle of each,
    ``dict_bytes`` in all. It is the only thing that is brought to the driver.
    Languages come in the order of their numbers of texts, most first.
    """
    rows = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(LETTER)
    )
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    different = rows.select("lang", F.xxhash64("text").alias("u")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    shares = {r["lang"]: min(1.0, docs_per_lang / r["n"]) for r in different.collect()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    drawn = rows.withColumn("u", F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))).where(
        F.col("u") < share[F.col("lang")]
    )
    spare = F.greatest(F.char_length("text") - chars_per_doc, F.lit(0))
    sample = drawn.select(
        "lang", "u", F.col("text").substr((spare / 2).cast("int") + 1, F.lit(chars_per_doc)).alias("text")
    ).distinct()
    out: dict[str, list[bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["u"], r["text"])):
        out.setdefault(r["lang"], []).append(normal(r["text"]))
    return {k: b" ".join(out[k])[:dict_bytes] for k in sorted(out, key=lambda k: (-counts[k], k))}


def coder(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    """A compressor primed with ``dictionary`` as raw content."""
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters.from_level(
            level, min_match=MATCH, write_content_size=False, write_dict_id=False
        ),
    )


def classify(dictionaries: dict[str, bytes], text: Column, min_margin: float = 0.004, level: int = 5) -> Column:
    """Struct of lang_pred, score (0 to 1), margin and rejected for ``text``.

    ``margin`` is the share of bytes that the best language saves against the second;
    below ``min_margin`` the text is rejected. ``score`` is the best language's share
    when every saved byte makes a language e times likelier.
    """
    langs = list(dictionaries)

    @F.pandas_udf(RESULT)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = [coder(d, level) for d in dictionaries.values()]

        def one(s: str | None):
            if s is None or not langs:
                return "und", 0.0, 0.0, True
            raw = normal(s)
            pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
            sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
            order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
            if len(order) == 1:
                return langs[0], 1.0, 1.0, False
            best, second = sizes[order[0]], sizes[order[1]]
            margin = (second - best) / second
            total = sum(2.718281828 ** -min(x - best, 600) for x in sizes)
            return langs[order[0]], 1.0 / total, margin, margin < min_margin

        for batch in batches:
            yield pd.DataFrame([one(s) for s in batch], columns=RESULT.names)

    return udf(F.when(text.rlike(LETTER), text))


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id_col`` with lang_pred, score, margin and rejected for every row of ``docs``."""
    found = classify(dictionaries, F.col("text"), **options)
    return docs.select(F.col(id_col), F.col(text).alias("text")).select(id_col, found.alias("found")).select(id_col, "found.*")


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified (not rejected)."""
    found = common.fresh(docs, "found")
    rows = docs.withColumn(found, classify(dictionaries, F.col(text), **options))
    return rows.where(~F.col(f"{found}.rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])
