"""Taxon link graphs: build links from three graphs, measure coverage and conflicts.

A link is a row ``(ext, term)``: an external id (``NCBI:9606``) and the
term of one graph that points to it (``OTT:770315``, ``WD:Q15978631``,
``GLOBI:<provided id>@<provided name>``).

Scale notes
-----------
* Nothing here collects the links of an id into one array. Per-id facts are
  computed from ``(ext, source)`` / ``(ext, term)`` rows that are combined
  map-side first, so an id holding a third of all links costs one row per
  partition before the shuffle, not one task holding all its links.
* The only arrays built are the distinct terms of an id (each with its
  multiplicity, after the map-side combined ``(ext, term)`` aggregate), used
  to build composite keys; a composite key *is* the sorted list of an id's
  other terms, so its size is the size of the result itself.
* Composite membership stays in long form ``(composite, ext)``; group-level
  numbers come from two-level aggregates, never from collected id lists.
* Conflict counts and the short-key exports identify a composite by
  (GLOBI term, signature of the other terms) and build no key strings
  (``composite_signatures``), so a hub id costs one row per GLOBI term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalake.functions.ids import (
    DEFAULT_SCHEMES,
    SOURCE_GLOBI,
    SOURCE_OTT,
    SOURCE_WD,
    in_schemes,
    java_split,
    java_trim,
    key_length,
    prefix_of,
    prefixed,
    scala_str,
)
from taxalake.operators.positions import chunked_lists

LINK_COLUMNS = ("ext", "term")


# ---------------------------------------------------------------- link builders


def ott_links(taxonomy: DataFrame, uid: str = "uid", sourceinfo: str = "sourceinfo") -> DataFrame:
    """Taxonomy rows -> links: every id in the comma list of ``sourceinfo``.

    Upper-cased, split on ``,`` with Java rules (trailing empties dropped),
    each id trimmed; the term is ``OTT:<uid>``. A null ``sourceinfo`` gives no link.
    """
    ids = java_split(F.upper(F.col(sourceinfo)), ",")
    return (
        taxonomy.select(F.explode(ids).alias("_id"), F.col(uid).alias("_uid"))
        .select(java_trim("_id").alias("ext"), java_trim(prefixed("OTT:", "_uid")).alias("term"))
    )


def wd_links(entity_links: DataFrame, entity: str = "entity", ext: str = "ext") -> DataFrame:
    """Entity links ``(entity, ext)`` -> ``(ext, WD:<entity>)`` (orientation swap)."""
    return entity_links.select(F.col(ext).alias("ext"), prefixed("WD:", entity).alias("term"))


def globi_links(
    taxon_map: DataFrame,
    provided_id: str = "providedTaxonId",
    provided_name: str = "providedTaxonName",
    resolved_id: str = "resolvedTaxonId",
) -> DataFrame:
    """Resolver map -> ``(resolved id, GLOBI:<provided id>@<provided name>)``.

    Null resolved ids and ids already in OTT or WD are left out; a null
    provided id or name prints as ``null`` inside the term.
    """
    rid = F.col(resolved_id)
    return taxon_map.where(
        rid.isNotNull() & ~rid.startswith("OTT:") & ~rid.startswith("WD:")
    ).select(
        rid.alias("ext"),
        F.concat(F.lit("GLOBI:"), scala_str(provided_id), F.lit("@"), scala_str(provided_name)).alias("term"),
    )


def link_union(*links: DataFrame, dedupe_links: bool = False) -> DataFrame:
    """Union all of link tables. Duplicates are kept, as the reference does, and so can
    stand twice in a composite key; ``dedupe_links`` keeps one of each."""
    out = links[0].select(*LINK_COLUMNS)
    for other in links[1:]:
        out = out.unionByName(other.select(*LINK_COLUMNS))
    return out.distinct() if dedupe_links else out


def with_parts(links: DataFrame) -> DataFrame:
    return links.withColumn("scheme", prefix_of("ext")).withColumn("source", prefix_of("term"))


def whitelisted(links: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """Links whose external id scheme is in the whitelist."""
    return links.where(in_schemes("ext", schemes))


# ---------------------------------------------------------------- per-source counts


def links_by_source_scheme(links: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """Number of links (not ids) per (source, scheme), whitelisted schemes only."""
    return (
        with_parts(whitelisted(links, schemes))
        .groupBy("source", "scheme")
        .agg(F.count(F.lit(1)).alias("n_links"))
    )


# ---------------------------------------------------------------- per-id profile


def id_profile(links: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """One row per whitelisted external id with the graphs that link to it.

    Columns: ext, scheme, n_links, n_sources (distinct term prefixes),
    has_ott, has_wd, has_globi. Two partial aggregates; no arrays.
    """
    per_source = (
        with_parts(whitelisted(links, schemes))
        .groupBy("ext", "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # fixed-width buffers only (no first(string)), so both steps are hash aggregates
    prof = per_source.groupBy("ext").agg(
        F.sum("n").alias("n_links"),
        F.count(F.lit(1)).alias("n_sources"),
        F.max(F.col("source") == SOURCE_OTT).alias("has_ott"),
        F.max(F.col("source") == SOURCE_WD).alias("has_wd"),
        F.max(F.col("source") == SOURCE_GLOBI).alias("has_globi"),
    )
    return prof.select(
        "ext", prefix_of("ext").alias("scheme"), "n_links", "n_sources", "has_ott", "has_wd", "has_globi"
    )


def region_of(profile: DataFrame) -> Column:
    """Venn region label: the sources present, sorted, joined with ``+``."""
    known = (
        F.col("has_globi").cast("int") + F.col("has_ott").cast("int") + F.col("has_wd").cast("int")
    )
    return F.concat_ws(
        "+",
        F.when(F.col("has_globi"), F.lit(SOURCE_GLOBI)),
        F.when(F.col("has_ott"), F.lit(SOURCE_OTT)),
        F.when(F.col("has_wd"), F.lit(SOURCE_WD)),
        F.when(F.col("n_sources") > known, F.lit("OTHER")),
    )


def coverage_report(profile: DataFrame) -> DataFrame:
    """All id-coverage counts of the three-graph analysis in one aggregate.

    ``ott_and_wd`` follows the reference's rule (distinct sources other than
    GLOBI number two), so it also counts ids that have GLOBI as well.
    """
    n = F.col("n_sources")
    g, o, w = F.col("has_globi"), F.col("has_ott"), F.col("has_wd")

    def cnt(cond: Column, name: str) -> Column:
        return F.count_if(cond).cast("bigint").alias(name)

    return profile.agg(
        F.count(F.lit(1)).cast("bigint").alias("total_ids"),
        cnt(n == 3, "all_three"),
        cnt((n - g.cast("int")) == 2, "ott_and_wd"),
        cnt(o, "has_ott"),
        cnt(w, "has_wd"),
        cnt(g, "has_globi"),
        cnt((n == 1) & g, "only_globi"),
        cnt((n == 1) & o, "only_ott"),
        cnt((n == 1) & w, "only_wd"),
        cnt((n == 2) & ~g, "two_no_globi"),
        cnt((n == 2) & ~o, "two_no_ott"),
        cnt((n == 2) & ~w, "two_no_wd"),
        cnt(~g, "no_globi"),
    )


def venn_by_scheme(profile: DataFrame) -> DataFrame:
    """Ids per (Venn region, scheme); contains the only-GLOBI, only-OTT,
    only-WD and all-three breakdowns of the reference."""
    return (
        profile.withColumn("region", region_of(profile))
        .groupBy("region", "scheme")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_ids"))
    )


def ids_by_scheme(profile: DataFrame) -> DataFrame:
    """Unique whitelisted ids per scheme."""
    return profile.groupBy("scheme").agg(F.count(F.lit(1)).cast("bigint").alias("n_ids"))


def term_lists(links: DataFrame, size: int = 1000, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """The terms of every whitelisted id in order, duplicates kept, in lists of at most ``size``:
    ext, chunk (from 0), terms. An id with very many terms has many rows, and none of them grows."""
    return chunked_lists(_term_counts(links, schemes), ["ext"], "term", size, count="mult", out="terms")


# ---------------------------------------------------------------- composites


def _term_counts(links: DataFrame, schemes) -> DataFrame:
    """ext, term, mult, is_globi. The flag is an aggregate, so a filter on it stays above the
    aggregate and the two halves of a plan that splits by it share one exchange."""
    return (
        whitelisted(links, schemes)
        .groupBy("ext", "term")
        .agg(F.count(F.lit(1)).alias("mult"), F.max(F.col("term").startswith(SOURCE_GLOBI)).alias("is_globi"))
    )


def composites(links: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """For each GLOBI term ``g`` of an id: key = sorted(other terms + g) joined ``|``.

    Other (non-GLOBI) terms keep their duplicates, as in the reference. Ids
    without a GLOBI term give no composite. Output: ext, composite,
    n_links (how many GLOBI links of the id gave that key).

    Plan: links -> (ext, term, mult) with a map-side combined aggregate (a hot
    id is spread over tasks by term and its duplicates collapse before the
    shuffle) -> one row per id with its distinct terms split by source ->
    explode the GLOBI terms. Two shuffles, no join, one scan of the links.
    """
    is_globi = F.col("is_globi")
    tm = F.struct("term", "mult")
    per_id = (
        _term_counts(links, schemes)
        .groupBy("ext")
        .agg(
            F.collect_list(F.when(is_globi, tm)).alias("_g"),
            F.collect_list(F.when(~is_globi, tm)).alias("_o"),
        )
        .where(F.size("_g") > 0)
    )
    others = F.array_sort(F.flatten(F.transform("_o", lambda s: F.array_repeat(s["term"], s["mult"].cast("int")))))
    exploded = per_id.select("ext", others.alias("_others"), F.explode("_g").alias("_gt"))
    return exploded.select(
        "ext",
        F.array_join(F.array_sort(F.concat("_others", F.array(F.col("_gt.term")))), "|").alias("composite"),
        F.col("_gt.mult").cast("bigint").alias("n_links"),
    )


def composite_ids(comps: DataFrame) -> DataFrame:
    """Distinct ids per composite, long form: (composite, ext)."""
    return comps.select("composite", "ext").distinct()


def _n_prefixes(schemes) -> Column:
    """Distinct id prefixes in a group whose ids all have whitelisted schemes:
    one max-flag per scheme (plain hash aggregate, no distinct aggregate)."""
    p = prefix_of("ext")
    total = F.lit(0)
    for sc in dict.fromkeys(schemes):
        total = total + F.max((p == sc).cast("int"))
    return total


def composite_stats(comps: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """Per composite: n_ids, repeats (ids minus distinct id prefixes), key_length.

    ``schemes`` is the whitelist the composites were built with; distinct
    prefixes are counted with one max-flag per scheme, so the aggregate is
    combined map-side and a composite that covers a large share of all ids
    sends one row per partition, not its ids.
    """
    return (
        composite_ids(comps)
        .groupBy("composite")
        .agg(
            F.count(F.lit(1)).cast("bigint").alias("n_ids"),
            (F.count(F.lit(1)) - _n_prefixes(schemes)).cast("bigint").alias("repeats"),
            key_length(F.col("composite")).alias("key_length"),
        )
    )


def composite_conflicts(comps: DataFrame) -> DataFrame:
    """Composites with their stats (all of them, repeats may be 0)."""
    return composite_stats(comps)


def conflicts_by_key_length(stats: DataFrame) -> DataFrame:
    """Number of composites with repeats > 0, per key length."""
    return (
        stats.where(F.col("repeats") > 0)
        .groupBy("key_length")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_composites"))
    )


def conflict_members(comps: DataFrame, stats: DataFrame, key_len: int) -> DataFrame:
    """Conflict export for one key length, long form: composite, ext, repeats, key_length.

    The reference writes the ids of a composite joined with ``|`` in one
    line; here each id is one row, so no row grows with the group.
    """
    conflicted = stats.where((F.col("repeats") > 0) & (F.col("key_length") == key_len)).select(
        "composite", "repeats", "key_length"
    )
    return composite_ids(comps).join(conflicted, "composite", "inner")


# ---------------------------------------------------------------- composites without key strings


def _pipes(c: Column) -> Column:
    """Number of ``|``-separated parts a term adds to a composite key."""
    return (F.length(c) - F.length(F.regexp_replace(c, r"\|", "")) + 1).cast("bigint")


def _h(c: Column, seed: int) -> Column:
    """A 64-bit hash that starts from the seed, so terms that collide under one seed don't under the other."""
    return F.xxhash64(F.lit(seed), c).cast("decimal(38,0)")


def composite_signatures(links: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """One row per (id, GLOBI term): the composite identified without its key.

    The other terms of an id are summarised by aggregates only: their count,
    two sums of independent 64-bit hashes (weighted by multiplicity, exact
    decimals, so no overflow) and their number of key parts. Equal multisets
    give equal signatures; different ones collide with probability ~2^-128.
    No array and no key string is built, so an id with many GLOBI terms and
    many other terms costs (GLOBI terms) rows, not (GLOBI x other) terms.
    Output: ext, g, n_links, n_others, s1, s2, key_length. The key length counts the
    ``|``-parts of every term; it equals the split of the key string except
    when the last sorted term ends in ``|`` (Java's split drops that empty
    tail).
    """
    return signatures(_term_counts(links, schemes))


def signatures(tc: DataFrame) -> DataFrame:
    """``composite_signatures`` from the links' term counts, which are read twice: store them first."""
    m = F.col("mult")
    others = (
        tc.where(~F.col("is_globi"))
        .groupBy("ext")
        .agg(
            F.sum(m).alias("n_others"),
            F.sum(_h(F.col("term"), 1) * m).alias("s1"),
            F.sum(_h(F.col("term"), 2) * m).alias("s2"),
            F.sum(_pipes(F.col("term")) * m).alias("parts"),
        )
    )
    g = tc.where("is_globi").select("ext", F.col("term").alias("g"), F.col("mult").cast("bigint").alias("n_links"))
    j = g.join(others, "ext", "left")
    zero = F.lit(0).cast("decimal(38,0)")
    return j.select(
        "ext",
        "g",
        "n_links",
        F.coalesce("n_others", F.lit(0)).cast("bigint").alias("n_others"),
        F.coalesce("s1", zero).alias("s1"),
        F.coalesce("s2", zero).alias("s2"),
        (F.coalesce("parts", F.lit(0)) + _pipes(F.col("g"))).cast("bigint").alias("key_length"),
    )


_SIG = ("g", "n_others", "s1", "s2")


def signature_stats(sigs: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """Per composite (by signature): n_ids, repeats, key_length."""
    return sigs.groupBy(*_SIG).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_ids"),
        (F.count(F.lit(1)) - _n_prefixes(schemes)).cast("bigint").alias("repeats"),
        F.max("key_length").alias("key_length"),
    )


def conflicts_by_key_length_fast(links: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """``conflicts_by_key_length`` without building any composite key."""
    return conflict_counts(signature_stats(composite_signatures(links, schemes), schemes))


def conflict_counts(stats: DataFrame) -> DataFrame:
    """Composites with repeats per key length, from their stats."""
    return (
        stats.where(F.col("repeats") > 0)
        .groupBy("key_length")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_composites"))
    )


def short_conflict_members(links: DataFrame, key_len: int, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """Conflict export for key length 1 or 2 (the reference's two exports),
    long form (composite, ext, repeats, key_length), keys built only for the
    exported composites, which hold at most one other term."""
    tc = _term_counts(links, schemes)
    sigs = signatures(tc)
    return short_members(sigs, signature_stats(sigs, schemes), key_len, tc)


def short_members(sigs: DataFrame, stats: DataFrame, key_len: int, terms: DataFrame) -> DataFrame:
    """``short_conflict_members`` from signatures, their stats and the links' term counts."""
    if key_len not in (1, 2):
        raise ValueError("short keys are of length 1 or 2; use conflict_members for longer keys")
    hit = stats.where((F.col("repeats") > 0) & (F.col("key_length") == key_len) & (F.col("n_others") <= 1))
    rows = sigs.join(hit.select(*_SIG, "repeats"), list(_SIG), "inner")
    # an id with one other term has one such row, so the join adds none
    other = terms.where(~F.col("is_globi") & (F.col("mult") == 1)).select("ext", F.col("term").alias("only_other"))
    rows = rows.join(other.withColumn("n_others", F.lit(1).cast("bigint")), ["ext", "n_others"], "left")
    key = F.when(F.col("n_others") == 0, F.col("g")).otherwise(F.array_join(F.array_sort(F.array("only_other", "g")), "|"))
    return rows.select(key.alias("composite"), "ext", "repeats", "key_length")


def term_counts(links: DataFrame, schemes=DEFAULT_SCHEMES) -> DataFrame:
    """Distinct whitelisted links with their number: ext, term, mult, is_globi."""
    return _term_counts(links, schemes)


def joined_members(members: DataFrame, size: int = 1000) -> DataFrame:
    """The conflict export's lines: composite, chunk, ids (in order, joined by ``|``, at most ``size`` a
    line), repeats, key_length. A composite of more ids goes on in further lines."""
    lists = chunked_lists(members, ["composite", "repeats", "key_length"], "ext", size, out="_ids")
    return lists.select("composite", "chunk", F.array_join("_ids", "|").alias("ids"), "repeats", "key_length")


def pipe_joined_ids(members: DataFrame) -> DataFrame:
    """Reference TSV shape (composite, ids joined by ``|``, repeats, key_length).

    For export of small reports only: the id list of a composite is built in
    one task, so use it on conflict exports, not on whole graphs.
    """
    return members.groupBy("composite", "repeats", "key_length").agg(
        F.array_join(F.array_sort(F.collect_list("ext")), "|").alias("ids")
    )
