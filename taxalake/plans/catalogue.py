"""Query catalogue: name -> callable(spark, sf_dir) -> DataFrame.

Each query runs a reference operator over adapter data derived from the
whole test tables. Computed columns are aliased to the names used by the
DuckDB texts in ``taxalake.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.functions import geometry as GEO
from taxalake.functions.casts import ITEM_COLUMNS, ITEM_RULES, SUBJECT_RULES, read_date
from taxalake.operators import catalog as CT
from taxalake.operators import entities as EN
from taxalake.operators import linkgraph as LG
from taxalake.operators import manifest as MF
from taxalake.operators import merge as MG
from taxalake.operators import sideload as SL
from taxalake.operators import validate as V
from taxalake.plans import adapters as A
from taxalake.session import read_table, scratch_path, spread
from taxalake.sinks import snapshot as SN
from taxalake.sinks.files import results, run_new, write_files
from taxalake.sinks.snapshot import materialize
from taxalake.sources import delimited as DL
from taxalake.sources.listed import read_files
from taxalake.sources.raster import decode_units
from taxalake.sources.text import read_lines, read_texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- link graph


def links_of(spark: SparkSession, sf: str) -> DataFrame:
    """Union of the three graphs' links, each built by its reference operator."""
    return LG.link_union(
        LG.ott_links(A.ott_taxonomy(spark, sf)),
        LG.wd_links(A.wd_entity_links(spark, sf)),
        LG.globi_links(A.globi_taxon_map(spark, sf)),
    )


@query
def link_union(spark, sf):
    return links_of(spark, sf)


@query
def link_union_distinct(spark, sf):
    """Every link once."""
    return LG.link_union(links_of(spark, sf), dedupe_links=True)


@query
def split_source_ids(spark, sf):
    """The taxonomy as a ``\t|\t``-separated file with a header, read back as
    a pipe table (stray tabs trimmed), then split into links."""
    path = scratch_path(spark, "taxonomy")
    A.ott_taxonomy(spark, sf).write.option("sep", "\t|\t").option("header", True).csv(path)
    return LG.ott_links(DL.read_pipe_table(spark, path))


@query
def links_by_source_scheme(spark, sf):
    return LG.links_by_source_scheme(links_of(spark, sf)).select(
        "source", "scheme", F.col("n_links").cast("bigint").alias("n_links")
    )


@query
def link_groups(spark, sf):
    p = LG.id_profile(links_of(spark, sf))
    return p.select(
        "ext",
        "scheme",
        F.col("n_links").cast("bigint").alias("n_links"),
        F.col("n_sources").cast("bigint").alias("n_sources"),
        "has_ott",
        "has_wd",
        "has_globi",
    )


@query
def ids_by_scheme(spark, sf):
    return LG.ids_by_scheme(LG.id_profile(links_of(spark, sf)))


@query
def coverage_report(spark, sf):
    return LG.coverage_report(LG.id_profile(links_of(spark, sf)))


@query
def venn_by_scheme(spark, sf):
    return LG.venn_by_scheme(LG.id_profile(links_of(spark, sf)))


def _composites(spark, sf):
    return LG.composites(links_of(spark, sf))


@query
def composites(spark, sf):
    return _composites(spark, sf)


@query
def composite_ids(spark, sf):
    return LG.composite_ids(_composites(spark, sf))


@query
def composite_conflicts(spark, sf):
    return LG.composite_conflicts(_composites(spark, sf))


@query
def composites_long(spark, sf):
    """Composites by signature, one row per (id, GLOBI term): no array, no key text, so a hub id costs its links."""
    return LG.composite_signatures(links_of(spark, sf)).select("ext", "g", "n_links", "n_others", "key_length")


@query
def composite_stats_long(spark, sf):
    """Ids, repeats and key length of every composite, grouped by signature."""
    stats = LG.signature_stats(LG.composite_signatures(links_of(spark, sf)))
    return stats.select("g", "n_others", "n_ids", "repeats", "key_length")


@query
def conflicts_by_key_length(spark, sf):
    # by composite signature: no key strings are built
    sigs = LG.signatures(_stored_term_counts(spark, sf))
    return LG.conflict_counts(LG.signature_stats(sigs))


def _stored_term_counts(spark, sf):
    """Distinct links with their number, written once: GLOBI and other terms are read from there."""
    return materialize(LG.term_counts(links_of(spark, sf)), scratch_path(spark, "term-counts"))


def _short_conflicts(spark, sf, key_len):
    terms = _stored_term_counts(spark, sf)
    sigs = materialize(LG.signatures(terms), scratch_path(spark, "signatures"))
    return LG.short_members(sigs, LG.signature_stats(sigs), key_len, terms)


@query
def conflicts_pair(spark, sf):
    return _short_conflicts(spark, sf, 2)


@query
def conflicts_single(spark, sf):
    return _short_conflicts(spark, sf, 1)


@query
def conflict_lines(spark, sf):
    """The pair export's lines; ids joined, at most 3 a line here."""
    return LG.joined_members(_short_conflicts(spark, sf, 2), 3)


@query
def term_lists(spark, sf):
    """The terms of every id, duplicates kept, at most 4 a row here."""
    lists = LG.term_lists(links_of(spark, sf), 4)
    return lists.select("ext", "chunk", F.array_join("terms", "|").alias("terms"), F.size("terms").cast("bigint").alias("n_terms"))


# ---------------------------------------------------------------- entity dump


def terms_of(spark, sf):
    return EN.terms_from_lines(A.entity_dump_lines(spark, sf))


def stored_terms(spark, sf):
    """Parsed terms written to Parquet and read back (the build job's stage)."""
    return materialize(terms_of(spark, sf), scratch_path(spark, "terms"))


@query
def entity_prefilter(spark, sf):
    lines = EN.prefilter_lines(A.entity_dump_lines(spark, sf))
    return lines.select(
        F.regexp_extract("line", r'"id":"(Q[0-9]+)"', 1).alias("entity_id"),
        F.col("line").endswith(",").alias("trailing_comma"),
    )


@query
def entity_dump_scan(spark, sf):
    """The dump as bz2 text files (one for each task of the spread lines), read back as lines and parsed."""
    path = scratch_path(spark, "entity-dump")
    A.entity_dump_lines(spark, sf).write.option("compression", "bzip2").text(path)
    t = EN.terms_from_lines(read_lines(spark, path))
    return t.select("id", F.array_join("sameAsIds", "|").alias("same_as_ids"), F.size("names").cast("bigint").alias("n_names"))


def broken_lines(spark, sf):
    """The dump's taxon lines (``entity``, ``line``), those of every 13th entity cut off, of every 17th of another type."""
    lines = EN.prefilter_lines(A.entity_dump_lines(spark, sf))
    k = F.regexp_extract("line", r'"id":"Q([0-9]+)"', 1).cast("bigint")
    line = F.when(k % 13 == 0, F.expr("substring(line, 1, length(line) div 2)")).when(k % 17 == 0, '{"id":"Q1","claims":"none"}')
    return lines.select(k.alias("entity"), F.coalesce(line, "line").alias("line"))


@query
def malformed_entities(spark, sf):
    """Lines of the dump that don't parse, with the reason."""
    return EN.split_malformed(broken_lines(spark, sf))[1].select("entity", "reason")


@query
def entities_without_malformed(spark, sf):
    """The terms of the lines that parse."""
    good = EN.split_malformed(broken_lines(spark, sf))[0]
    return EN.parse_entities(good).select(F.col("e.id").alias("id"))


@query
def entity_terms(spark, sf):
    t = terms_of(spark, sf)
    return t.select(
        "id",
        F.array_join("names", "|").alias("names"),
        F.array_join("rankIds", "|").alias("rank_ids"),
        F.array_join("parentIds", "|").alias("parent_ids"),
        F.array_join("sameAsIds", "|").alias("same_as_ids"),
    )


@query
def entity_links(spark, sf):
    links = EN.entity_links(stored_terms(spark, sf))
    return materialize(links, scratch_path(spark, "entity-links"))


@query
def multi_valued_names(spark, sf):
    return EN.multi_valued(terms_of(spark, sf), "names")


@query
def multi_valued_ranks(spark, sf):
    return EN.multi_valued(terms_of(spark, sf), "rankIds")


@query
def multi_valued_parents(spark, sf):
    return EN.multi_valued(terms_of(spark, sf), "parentIds")


@query
def same_as_histogram(spark, sf):
    return EN.same_as_histogram(terms_of(spark, sf))


@query
def distinct_entities(spark, sf):
    return EN.distinct_entities(EN.entity_links(terms_of(spark, sf)))


@query
def distinct_ids_by_prefix(spark, sf):
    return EN.distinct_ids_by_prefix(EN.entity_links(terms_of(spark, sf)))


# ---------------------------------------------------------------- merge


@query
def merge_cache(spark, sf):
    return MG.merge_cache(A.resolver_cache(spark, sf), terms_of(spark, sf))


@query
def merge_cache_nulls(spark, sf):
    """The merged cache with empty texts as nulls."""
    return MG.merge_cache(A.resolver_cache(spark, sf), terms_of(spark, sf), empty_as_null=True)


@query
def merge_rewire(spark, sf):
    return MG.rewire(A.resolver_map(spark, sf), terms_of(spark, sf))


@query
def merge_map(spark, sf):
    return MG.merge_map(A.resolver_map(spark, sf), terms_of(spark, sf))


@query
def merge_cache_order(spark, sf):
    """The merged cache in the order of its export."""
    return MG.in_order(MG.merge_cache(A.resolver_cache(spark, sf), terms_of(spark, sf)), ["id", "name"])


@query
def merge_map_order(spark, sf):
    """The merged map in the order of its export."""
    return MG.in_order(MG.merge_map(A.resolver_map(spark, sf), terms_of(spark, sf)), list(MG.MAP_COLUMNS))


# ---------------------------------------------------------------- typed ingest


def typed_items(spark, sf):
    return V.type_rows(A.raw_items(spark, sf), ITEM_RULES)


@query
def free_dates(spark, sf):
    """Order dates written in twelve ways, read back by the date grammar, with and without filling what is missing."""
    ways = (
        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "M/d/yyyy h:mm a", "d/M/yyyy", "MMM d, yyyy", "d MMMM yyyy", "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
        "yyyyMMdd", "yyyy.M.d", "dd-MMM-yyyy", "M/d/yy", "MMMM yyyy", "'around' yyyy",
    )
    text = F.element_at(F.array(*[F.date_format("o_orderdate", w) for w in ways]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    rows = read_table(spark, sf, "orders").select("o_orderkey", text.alias("written"))
    return rows.select(
        "o_orderkey", read_date(F.col("written")).alias("date"), read_date(F.col("written"), day_first=True, partial="first").alias("filled")
    )


@query
def typed_ingest(spark, sf):
    good, _ = V.split_valid(typed_items(spark, sf))
    return good


@query
def typed_ingest_required(spark, sf):
    good, _ = V.split_valid(V.type_rows(A.raw_subjects(spark, sf), SUBJECT_RULES))
    return good


@query
def reject_report(spark, sf):
    return V.reject_report(typed_items(spark, sf))


@query
def error_budget(spark, sf):
    # the reference's reader: reading stops at the 51st bad row
    return V.apply_error_budget(typed_items(spark, sf), order="rn", budget=50, on_exceed="truncate")


@query
def keep_all_good(spark, sf):
    """The default: every good row, however many rows are bad."""
    return V.apply_error_budget(typed_items(spark, sf), order="rn", budget=50)


@query
def row_slice(spark, sf):
    # the reference's slice of the item dump: last 181461 lines, first 15000 of them
    o = read_table(spark, sf, "orders")
    return V.row_slice(o, "o_orderkey", tail=181_461, head=15_000)


@query
def row_slice_inner(spark, sf):
    """A slice with both bounds inside the smallest table."""
    return V.row_slice(read_table(spark, sf, "orders"), "o_orderkey", tail=900, head=300)


# ---------------------------------------------------------------- files: write and read back


@query
def ingest_tsv_roundtrip(spark, sf):
    """Item dump written as quoted TSV (line breaks inside fields), read back
    with the dump reader, typed and validated."""
    raw = A.raw_items(spark, sf)
    path = scratch_path(spark, "items-tsv")
    cols = ["rn"] + list(ITEM_COLUMNS)
    SN.export_delimited(raw.select(*cols), path, sep="\t", header=True)
    back = DL.read_quoted_table(spark, path, cols).withColumn("rn", F.col("rn").cast("bigint"))
    good, _ = V.split_valid(V.type_rows(back, ITEM_RULES))
    return good


@query
def delimited_roundtrip(spark, sf):
    """Customer written as bz2 header TSV (many files), read back typed."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = scratch_path(spark, "customer-tsv")
    spread(c, 200_000).write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "bzip2").csv(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"
    return DL.read_delimited(spark, path, sep="\t", header=True, schema=schema)


@query
def headerless_csv_scan(spark, sf):
    """Orders written as headerless CSV over many files, scanned by glob with a
    typed schema."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"),
        "o_orderpriority",
    )
    path = scratch_path(spark, "orders-csv")
    o.write.mode("overwrite").option("header", False).csv(path)
    schema = (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate date, o_orderpriority string"
    )
    return DL.read_delimited(spark, f"{path}/*.csv", sep=",", header=False, schema=schema)


@query
def snapshot_roundtrip(spark, sf):
    """Write (fail if present), overwrite, read back."""
    o = read_table(spark, sf, "orders")
    path = SN.snapshot_name(scratch_path(spark, "snap"), "orders", "20240101T000000")
    SN.write_snapshot(o, path)
    SN.write_snapshot(o, path, overwrite=True)
    return spark.read.parquet(path)


@query
def snapshot_partition_scan(spark, sf):
    """Events in a source=/date= layout; the newest date of one source."""
    e = read_table(spark, sf, "events").select(
        "event_id", "user_id", "value", "props",
        F.col("event_type").alias("source"), F.date_format("ts", "yyyyMMdd").alias("date"),
    )
    base = scratch_path(spark, "events-by-source")
    SN.write_snapshot(e, base, partition_by=("source", "date"))
    out = SN.newest_partition(spark, base, "click")
    return out.select("event_id", "user_id", "value", "props", "source", F.col("date").cast("string").alias("date"))


@query
def editions_counts(spark, sf):
    e = read_table(spark, sf, "events")
    written = SN.write_editions(e, scratch_path(spark, "editions"), "events", "20240101T000000")
    return SN.edition_counts(spark, written)


@query
def editions_cut(spark, sf):
    """Editions smaller than the table."""
    e = read_table(spark, sf, "events")
    base = scratch_path(spark, "editions-cut")
    return SN.edition_counts(spark, SN.write_editions(e, base, "events", "20240101T000000", {"small": 300, "half": 700}))


@query
def edition_ordered_cut(spark, sf):
    o = read_table(spark, sf, "orders")
    base = scratch_path(spark, "editions-ordered-cut")
    written = SN.write_editions(o, base, "orders", "20240101T000000", {"700": 700}, order=["o_orderkey"])
    return spark.read.parquet(written["700"])


@query
def snapshot_guard(spark, sf):
    """A second write without overwrite fails and leaves the first as it is."""
    path = scratch_path(spark, "guard")
    r = read_table(spark, sf, "region")
    SN.write_snapshot(r, path)
    try:
        SN.write_snapshot(r.limit(1), path)
        guarded = False
    except AnalysisException:
        guarded = True
    return spark.read.parquet(path).withColumn("guarded", F.lit(guarded))


@query
def histogram_export(spark, sf):
    """A small report as one delimited file, read back."""
    path = scratch_path(spark, "histogram")
    SN.export_delimited(EN.same_as_histogram(terms_of(spark, sf)), path, sort_by=["n_ids"], single_file=True)
    return DL.read_delimited(spark, path, schema="n_ids bigint, n_entities bigint")


@query
def edition_ordered(spark, sf):
    """The first 100k orders by key (an ordered edition)."""
    o = read_table(spark, sf, "orders")
    written = SN.write_editions(
        o, scratch_path(spark, "editions-ordered"), "orders", "20240101T000000", {"100k": 100_000}, order=["o_orderkey"]
    )
    return spark.read.parquet(written["100k"])


# ---------------------------------------------------------------- texts, manifests, listings, samples


def _items_with_text(spark, sf):
    items = read_table(spark, sf, "part").select("p_partkey", "p_name")
    texts = read_table(spark, sf, "documents").select("doc_id", "text")
    return SL.sideload_text(items, texts, key="p_partkey", text_key="doc_id")


@query
def mirror_sideload(spark, sf):
    """Texts written as one file a key, listed and read back, and loaded onto the items."""
    folder = scratch_path(spark, "mirror")
    docs = read_table(spark, sf, "documents")
    write_files(docs.select(MF.file_name(F.col("doc_id").cast("string"), F.lit("_djvu.txt")).alias("name"), "text"), folder, content="text")
    items = read_table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("barcode"), "p_name")
    return SL.sideload_text(items, read_texts(spark, folder, null_on_bad_utf8=True))


@query
def tile_reruns(spark, sf):
    """Tiles written from suppliers and decoded; then those of nation 0 change, and only they are decoded again."""
    folder, log = scratch_path(spark, "tiles"), scratch_path(spark, "tile-log")
    tiles = A.tile_contents(spark, sf)
    raised = F.transform("heights", lambda h: h + 1)
    for rows, heights in ((tiles, F.col("heights")), (tiles.where("nation = 0"), raised)):
        write_files(rows.select("name", A.heights_as_bytes(heights).alias("content")), folder)
        units = read_files(spark, folder, ".hgt").select(F.col("name").alias("unit"), "content")
        run_new(units, log, decode_units(samples=3))
    return results(spark, log).select("tile", "x", "y", F.col("height").cast("int").alias("height"), "version")


@query
def sideload_text(spark, sf):
    return _items_with_text(spark, sf)


@query
def text_coverage(spark, sf):
    return SL.text_coverage(_items_with_text(spark, sf))


@query
def hash_sample(spark, sf):
    return SL.hash_sample(read_table(spark, sf, "documents"), "doc_id", 0.1)


@query
def missing_manifest(spark, sf):
    keys = read_table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("barcode"))
    present = (
        read_table(spark, sf, "part")
        .where(F.col("p_size") < 20)
        .select(MF.file_name(F.col("p_partkey").cast("string"), F.lit("_djvu.txt")).alias("file"))
    )
    return MF.missing_manifest(keys, present)


@query
def archive_listing(spark, sf):
    """Sequence files of an archive index, by the reference's rule."""
    return MF.listing_links(A.archive_pages(spark, sf))


@query
def listing_links(spark, sf):
    pages = read_table(spark, sf, "pages")
    return MF.listing_links(pages, line_sep="<li>", must_contain=("href=",), must_start="<a ")


# ---------------------------------------------------------------- records and field catalogues


def _records_path(spark, sf):
    path = scratch_path(spark, "records")
    A.records(spark, sf).write.mode("overwrite").parquet(path)
    return path


@query
def records_scan(spark, sf):
    fields = ["uuid", "genus", "individualcount", "flags", "data.dwc:eventDate", "commonnames"]
    return CT.read_records(spark, _records_path(spark, sf), fields=fields)


def _fields_kept(spark, sf, load):
    path = scratch_path(spark, "records-all-fields")
    A.records_all_fields(spark, sf).write.parquet(path)
    return CT.read_records(spark, path, exclude=CT.BAD_FIELDS[load])


@query
def record_fields(spark, sf):
    return _fields_kept(spark, sf, "records")


@query
def media_fields(spark, sf):
    return _fields_kept(spark, sf, "media")


@query
def mini_fields(spark, sf):
    return _fields_kept(spark, sf, "mini")


@query
def uuid_head(spark, sf):
    """One column of the records, the first ten of its values."""
    return CT.read_records(spark, _records_path(spark, sf), fields=["uuid"]).orderBy("uuid").limit(10)


@query
def term_filter(spark, sf):
    c = read_table(spark, sf, "customer")
    return CT.term_filter(c, {"c_mktsegment": "Building", "c_nationkey": 7})


@query
def as_array_fields(spark, sf):
    recs = CT.read_records(spark, _records_path(spark, sf), array_fields=("genus", "commonnames"),
                           where={"genus": "click"}, exclude=())
    return recs.select(
        "uuid",
        F.array_join("genus", "|").alias("genus"),
        F.size("genus").cast("bigint").alias("n_genus"),
        F.array_join("commonnames", "|").alias("commonnames"),
    )


@query
def boolean_projection(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", (F.col("event_type") == "click").alias("is_click"))


@query
def field_inventory(spark, sf):
    return CT.json_field_inventory(read_table(spark, sf, "events"), "props")


@query
def field_catalog(spark, sf):
    return CT.catalog_fields(A.field_meta_docs(spark, sf), types=True)


@query
def field_list(spark, sf):
    return CT.catalog_fields(A.field_meta_docs(spark, sf))


@query
def field_drift(spark, sf):
    meta = CT.catalog_fields(A.field_meta_docs(spark, sf), types=True)
    table = CT.schema_fields_df(spark, A.records(spark, sf))
    return CT.field_drift(meta, table, "meta", "table")


@query
def probe_fields(spark, sf):
    expected = {"rn": "bigint", "ItemID": "int", "TitleID": "int", "ThumbnailPageID": "int", "CreationDate": "timestamp"}
    return CT.probe_fields(A.raw_items(spark, sf), expected)


# ---------------------------------------------------------------- tiles and grids


@query
def tile_name_parse(spark, sf):
    return GEO.parse_tile_name(A.tile_names(spark, sf), "fname")


@query
def grid_cells(spark, sf):
    return GEO.grid_cells(A.embedding_grids(spark, sf), samples=8)


# ---------------------------------------------------------------- coverage map

# SURVEY §2 inventory IDs each registered query exercises. Fixture tests
# only: K3 (stamps), S6 (keyed text files), S7 (binary tiles), L3 (sorted
# exports); L10 (caching) has no result of its own.
FIXTURE_ONLY = "K3 S6 S7 L3 L10"
COVERS: dict[str, str] = {
    "link_union_distinct": "E4 L5 L6",
    "malformed_entities": "X2 S5",
    "entities_without_malformed": "X2 S5",
    "merge_cache_nulls": "F10 L6 X14",
    "free_dates": "V2",
    "link_union": "E2 E4 L5 X13 F11 E3 X15 S9",
    "split_source_ids": "E3 X15 S3",
    "links_by_source_scheme": "A5 F12 X16",
    "link_groups": "A6 J5 F12 X16",
    "ids_by_scheme": "A15",
    "coverage_report": "A7 A8 A9 A10 A11 A12 A13 X17",
    "venn_by_scheme": "A14",
    "composites": "A16 X18 X10",
    "composites_long": "A16 X18",
    "composite_stats_long": "A18 X19 X20",
    "composite_ids": "A17",
    "composite_conflicts": "A18 X19 X20",
    "conflicts_by_key_length": "A19",
    "conflicts_pair": "A20",
    "conflict_lines": "A17 A20",
    "mirror_sideload": "S6 J1",
    "tile_reruns": "S7 K8",
    "term_lists": "A6 J5",
    "merge_cache_order": "L3",
    "merge_map_order": "L3",
    "conflicts_single": "A20",
    "entity_prefilter": "F9 X1 S5",
    "entity_dump_scan": "S5 F9 X1 X2",
    "entity_terms": "X2 X3 X4 X5 X7 X8 X9",
    "entity_links": "E1 X6 K6",
    "multi_valued_names": "A21 X10 X11",
    "multi_valued_ranks": "A21",
    "multi_valued_parents": "A21",
    "same_as_histogram": "A4 X11",
    "distinct_entities": "A2 L8",
    "distinct_ids_by_prefix": "A3 F13",
    "merge_cache": "E5 F10 X12 X14 X25 L6",
    "merge_rewire": "E6 J2",
    "merge_map": "L7 J2",
    "typed_ingest": "V1 V2 V4 V6",
    "typed_ingest_required": "V3",
    "reject_report": "A22 V4",
    "error_budget": "V5",
    "row_slice": "V7 L2",
    "row_slice_inner": "V7 L2",
    "keep_all_good": "V5",
    "editions_cut": "K4 L1 A1",
    "edition_ordered_cut": "K4 L1 L2",
    "snapshot_guard": "K7",
    "histogram_export": "K5 L11 A4",
    "record_fields": "F7",
    "media_fields": "F7",
    "mini_fields": "F7",
    "uuid_head": "F16",
    "field_list": "F4",
    "archive_listing": "S10",
    "ingest_tsv_roundtrip": "S1 K5",
    "delimited_roundtrip": "S2",
    "headerless_csv_scan": "S4",
    "snapshot_roundtrip": "K1 K2",
    "snapshot_partition_scan": "K9",
    "editions_counts": "K4 L1 A1",
    "edition_ordered": "K4 L1 L2",
    "sideload_text": "J1",
    "text_coverage": "F15",
    "hash_sample": "L4",
    "missing_manifest": "V8 V9 K8 J3 J4 X24",
    "listing_links": "S10",
    "records_scan": "S8 F1 F7",
    "term_filter": "F2",
    "as_array_fields": "F3",
    "boolean_projection": "F14",
    "field_inventory": "F6",
    "field_catalog": "F4 F5",
    "field_drift": "F5 F6 L9",
    "probe_fields": "F8",
    "tile_name_parse": "X21",
    "grid_cells": "X22 X23",
}
