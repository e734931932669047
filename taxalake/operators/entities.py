"""Entity dump -> taxon terms -> links, and the side reports of the build job.

The dump is one JSON object per line inside a giant array, each line ending
in ``,``. Lines are cheap-filtered on a marker before parsing, parsed with
``from_json`` against a schema that names only the claims we read (the JSON
reader skips every other property without building it), and turned into
``TaxonTerm`` rows with Column expressions only.

Selection rules (see SURVEY Q1, Q2):

* ``multi_claims='strict'`` (reference): an instance test or an external id
  counts only when its property has exactly one claim.
  ``'all'``: any claim counts, the first one is taken for ids.
* ``deep_keys='strict'`` (default, reference): names, ranks and parents come
  from a deep search, so the list is empty when the property key also appears
  elsewhere in the entity (e.g. inside a qualifier). ``'claims'``: they are
  read from the entity's claims only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalake.functions.once import select_once

# Fixed values that must equal the reference's for equal results.
# Instance-of property and the taxon class; name, rank and parent properties.
INSTANCE_OF = "P31"
TAXON_NUMERIC_ID = "16521"
TAXON_MARKER = 'Q16521"'
NAME_PROP = "P225"
RANK_PROP = "P105"
PARENT_PROP = "P171"
# External id schemes and their properties, in output order.
ID_SCHEMES = (
    ("NCBI", "P685"),
    ("ITIS", "P815"),
    ("EOL", "P830"),
    ("FISHBASE", "P938"),
    ("GBIF", "P846"),
    ("IF", "P1391"),
    ("INAT_TAXON", "P41964"),
    ("WORMS", "P850"),
)

TERM_COLUMNS = ("id", "names", "rankIds", "parentIds", "sameAsIds")


def prefilter_lines(lines: DataFrame, marker: str = TAXON_MARKER, col: str = "value") -> DataFrame:
    """Keep lines that mention the marker; strip the line end and one trailing comma."""
    v = F.col(col)
    return lines.where(v.contains(marker)).select(
        F.regexp_replace(F.regexp_replace(v, r"[\r\n]+$", ""), ",$", "").alias("line")
    )


def _props(schemes) -> list[str]:
    props = [INSTANCE_OF, NAME_PROP, RANK_PROP, PARENT_PROP] + [p for _, p in schemes]
    return list(dict.fromkeys(props))


def entity_schema(schemes=ID_SCHEMES) -> str:
    claim = "array<struct<mainsnak: struct<datavalue: struct<value: string>>>>"
    fields = ", ".join(f"`{p}`: {claim}" for p in _props(schemes))
    return f"id string, claims struct<{fields}>"


def parse_entities(lines: DataFrame, schemes=ID_SCHEMES, mode: str = "FAILFAST", col: str = "line") -> DataFrame:
    """Parse JSON lines. Nested values (objects) stay as JSON text in ``value``.

    ``mode='FAILFAST'`` fails the job on a malformed line, as the reference
    does; ``'PERMISSIVE'`` gives a null entity instead. The raw line is kept
    for the strict deep-key rule.
    """
    parsed = F.from_json(F.col(col), entity_schema(schemes), {"mode": mode})
    # Parsed once per line: without the barrier, filter pushdown would copy
    # the parse into every predicate that reads a field of the entity.
    return select_once(lines, parsed.alias("e"), F.col(col).alias("line"))


def split_malformed(lines: DataFrame, schemes=ID_SCHEMES, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(lines that parse, the others with a ``reason``): with it a malformed line costs
    itself, not the job. Reasons: ``empty`` (null or blank), ``no JSON object`` (cut off, or another kind of
    value), ``other types`` (an object whose fields aren't of the types that are read)."""
    schema = f"{entity_schema(schemes)}, `_corrupt` string"
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    blank = F.coalesce(F.trim(F.col(col)) == "", F.lit(True))
    reason = (
        F.when(blank, "empty")
        .when(F.json_object_keys(F.col(col)).isNull(), "no JSON object")
        .when(parsed["_corrupt"].isNotNull(), "other types")
    )
    judged = select_once(lines, *[F.col(c) for c in lines.columns], reason.alias("reason"))
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def _values(prop: str) -> Column:
    return F.transform(F.col(f"e.claims.`{prop}`"), lambda c: c["mainsnak"]["datavalue"]["value"])


def _ids(prop: str) -> Column:
    return F.filter(
        F.transform(_values(prop), lambda v: F.get_json_object(v, "$.id")), lambda x: x.isNotNull()
    )


def _is_nested(x: Column) -> Column:
    """The value text is a JSON object or array (not a string that merely
    starts with a bracket, like ``[Clostridium] difficile``)."""
    return (x.startswith("{") & F.json_object_keys(x).isNotNull()) | (
        x.startswith("[") & F.json_array_length(x).isNotNull()
    )


def _strings(prop: str) -> Column:
    return F.filter(_values(prop), lambda x: x.isNotNull() & ~_is_nested(x))


def _claim_count(prop: str) -> Column:
    return F.coalesce(F.size(F.col(f"e.claims.`{prop}`")), F.lit(0))


def _key_count(prop: str) -> Column:
    return F.regexp_count(F.col("line"), F.lit(f'"{prop}"\\s*:'))


def is_taxon(multi_claims: str = "strict") -> Column:
    numeric = F.transform(_values(INSTANCE_OF), lambda v: F.get_json_object(v, "$.numeric-id"))
    if multi_claims == "strict":
        return (_claim_count(INSTANCE_OF) == 1) & (F.element_at(numeric, 1) == TAXON_NUMERIC_ID)
    return F.coalesce(F.array_contains(numeric, TAXON_NUMERIC_ID), F.lit(False))


def same_as_ids(schemes=ID_SCHEMES, multi_claims: str = "strict") -> Column:
    """``SCHEME:value`` per scheme in order; at most one per scheme."""
    parts = []
    for scheme, prop in schemes:
        vals = _strings(prop)
        first = F.element_at(vals, 1)
        ok = F.size(vals) >= 1
        if multi_claims == "strict":
            ok = ok & (_claim_count(prop) == 1)
        parts.append(F.when(ok, F.concat(F.lit(f"{scheme}:"), first)))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _deep(prop: str, values: Column, deep_keys: str) -> Column:
    if deep_keys == "strict":
        return F.when(_key_count(prop) <= 1, values).otherwise(F.array().cast("array<string>"))
    return values


def entity_terms(
    parsed: DataFrame, schemes=ID_SCHEMES, multi_claims: str = "strict", deep_keys: str = "strict"
) -> DataFrame:
    """Taxon terms: id, names, rankIds, parentIds, sameAsIds (arrays of string)."""
    empty = F.array().cast("array<string>")
    return parsed.where(F.col("e").isNotNull() & is_taxon(multi_claims)).select(
        F.coalesce(F.col("e.id"), F.lit("")).alias("id"),
        F.coalesce(_deep(NAME_PROP, _strings(NAME_PROP), deep_keys), empty).alias("names"),
        F.coalesce(_deep(RANK_PROP, _ids(RANK_PROP), deep_keys), empty).alias("rankIds"),
        F.coalesce(_deep(PARENT_PROP, _ids(PARENT_PROP), deep_keys), empty).alias("parentIds"),
        same_as_ids(schemes, multi_claims).alias("sameAsIds"),
    )


def terms_from_lines(lines: DataFrame, col: str = "value", **kw) -> DataFrame:
    """The whole build step: prefilter -> parse -> terms."""
    mode = kw.pop("mode", "FAILFAST")
    schemes = kw.get("schemes", ID_SCHEMES)
    return entity_terms(parse_entities(prefilter_lines(lines, col=col), schemes, mode), **kw)


def entity_links(terms: DataFrame) -> DataFrame:
    """Terms -> (entity, ext) links, one per external id."""
    return terms.select(F.col("id").alias("entity"), F.explode("sameAsIds").alias("ext"))


def multi_valued(terms: DataFrame, column: str) -> DataFrame:
    """Entities with more than one value in ``column``: (size, id, values joined by ``|``)."""
    return terms.select(
        F.size(column).cast("bigint").alias("n_values"),
        F.col("id"),
        F.array_join(column, "|").alias("joined"),
    ).where(F.col("n_values") > 1)


def same_as_histogram(terms: DataFrame) -> DataFrame:
    """Number of entities per count of external ids."""
    return terms.groupBy(F.size("sameAsIds").cast("bigint").alias("n_ids")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_entities")
    )


def distinct_entities(links: DataFrame) -> DataFrame:
    """Distinct entities that have at least one link."""
    return links.agg(F.count_distinct("entity").cast("bigint").alias("n_entities"))


def distinct_ids_by_prefix(links: DataFrame) -> DataFrame:
    """Distinct external ids per scheme prefix (the reference asks for EOL)."""
    from taxalake.functions.ids import prefix_of

    return (
        links.select(prefix_of("ext").alias("prefix"), "ext")
        .distinct()
        .groupBy("prefix")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_ids"))
    )
