"""Merge the Wikidata taxon graph into a GloBI taxon cache and taxon map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalake.functions.ids import scala_str
from taxalake.operators.positions import numbered
from taxalake.operators.skewjoin import heavy_join
from taxalake.session import scratch_path
from taxalake.sinks.snapshot import materialize

# Fixed values that must equal the reference's for equal results.
CACHE_COLUMNS = (
    "id",
    "name",
    "rank",
    "commonNames",
    "path",
    "pathIds",
    "pathNames",
    "externalUrl",
    "thumbnailUrl",
)
MAP_COLUMNS = ("providedTaxonId", "providedTaxonName", "resolvedTaxonId", "resolvedTaxonName")
ENTITY_URL = "https://www.wikidata.org/wiki/"
PATH_SEP = " | "


def non_empty(terms: DataFrame, columns=("names", "sameAsIds", "rankIds")) -> DataFrame:
    """Keep terms whose listed arrays all have at least one element."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.size(c) > 0)
    return terms.where(cond)


def cache_from_terms(terms: DataFrame) -> DataFrame:
    """Terms -> TaxonCache rows (WD ids, first name and rank, paths of the parents)."""
    t = non_empty(terms)
    name = F.element_at("names", 1)
    rank = F.concat(F.lit("WD:"), F.element_at("rankIds", 1))
    blanks = F.transform("parentIds", lambda _: F.lit(""))
    return t.select(
        F.concat(F.lit("WD:"), scala_str("id")).alias("id"),
        name.alias("name"),
        rank.alias("rank"),
        F.lit("").alias("commonNames"),
        F.array_join(F.concat(blanks, F.array(name)), PATH_SEP).alias("path"),
        F.array_join(
            F.concat(F.transform("parentIds", lambda p: F.concat(F.lit("WD:"), p)), F.array(F.concat(F.lit("WD:"), F.col("id")))),
            PATH_SEP,
        ).alias("pathIds"),
        F.array_join(F.concat(blanks, F.array(rank)), PATH_SEP).alias("pathNames"),
        F.concat(F.lit(ENTITY_URL), F.col("id")).alias("externalUrl"),
        F.lit("").alias("thumbnailUrl"),
    )


def map_from_terms(terms: DataFrame) -> DataFrame:
    """Terms -> TaxonMap rows (WD id, first name, external id, empty name)."""
    t = non_empty(terms)
    return t.select(
        F.concat(F.lit("WD:"), scala_str("id")).alias("providedTaxonId"),
        F.element_at("names", 1).alias("providedTaxonName"),
        F.explode("sameAsIds").alias("resolvedTaxonId"),
        F.lit("").alias("resolvedTaxonName"),
    )


def merge_cache(globi_cache: DataFrame, terms: DataFrame, empty_as_null: bool = False) -> DataFrame:
    """Union by position of the GloBI cache and the WD cache rows, distinct.

    Null (from CSV) and ``""`` (from terms) stay different, as in the
    reference; ``empty_as_null`` makes both null before the distinct, so that rows which
    differ in nothing else become one. Sort with ``orderBy('id', 'name')`` only for an export.
    """
    g = globi_cache.select(*[F.col(c).cast("string") for c in globi_cache.columns[: len(CACHE_COLUMNS)]]).toDF(
        *CACHE_COLUMNS
    )
    rows = g.union(cache_from_terms(terms))
    if empty_as_null:
        rows = rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in CACHE_COLUMNS])
    return rows.distinct()


def rewire(globi_map: DataFrame, terms: DataFrame) -> DataFrame:
    """Inner join on the resolved id: GloBI provided id/name, WD id/name.

    Duplicates multiply and null keys drop, as an inner equi-join does.
    An id that many rows resolve to is dealt over many tasks (``operators.skewjoin``).
    """
    return _rewired(globi_map.select(*_PROVIDED), _targets(terms))


_PROVIDED = ("providedTaxonId", "providedTaxonName", "resolvedTaxonId")


def _targets(terms: DataFrame) -> DataFrame:
    return map_from_terms(terms).select(
        F.col("resolvedTaxonId").alias("_rid"),
        F.col("providedTaxonId").alias("_wd_id"),
        F.col("providedTaxonName").alias("_wd_name"),
    )


def _rewired(provided: DataFrame, targets: DataFrame) -> DataFrame:
    # written once: the join reads its sides three times
    spark = provided.sparkSession
    provided = materialize(provided, scratch_path(spark, "provided"))
    targets = materialize(targets, scratch_path(spark, "targets"))
    return heavy_join(provided, targets, "resolvedTaxonId", "_rid").select(
        "providedTaxonId",
        "providedTaxonName",
        F.col("_wd_id").alias("resolvedTaxonId"),
        F.col("_wd_name").alias("resolvedTaxonName"),
    )


def merge_map(globi_map: DataFrame, terms: DataFrame) -> DataFrame:
    """GloBI map union the re-pointed rows, distinct. Both sides of the join are distinct
    before it, so duplicates don't multiply."""
    g = globi_map.select(*MAP_COLUMNS)
    return g.union(_rewired(g.select(*_PROVIDED).distinct(), _targets(terms).distinct())).distinct()


def in_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``position``, their number (from 1) in the order of ``by``; the other columns break
    ties. This is the order of the sorted exports; no task gets more than its range of it."""
    ties = [c for c in rows.columns if c not in by]
    return numbered(rows, [F.col(c).asc_nulls_first() for c in [*by, *ties]])
