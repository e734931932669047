"""A pipeline from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents. All but the last return the columns of
``documents``; the last one adds ``copies``.

Results by case: an empty table gives an empty table; null texts go in the first stage
(no language); further cases are stated at the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.llm import common, decontaminate, jaccard, langid, mixing, templates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language compression can't tell."""
    return langid.keep_identified(docs, langid.fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of templates that recur across documents, and passages that two share, from all but the first of them."""
    found = templates.dedup(docs, long_docs=2).select(*docs.columns)
    return found.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links of five-word shingles at 0.8 connect."""
    return jaccard.keep_one(docs, n=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their numbers of copies."""
    return mixing.take(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
