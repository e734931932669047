"""End-to-end jobs: the reference's scripts as Spark jobs.

Each job takes input paths and an output folder, and writes its results as
Parquet (plus delimited exports where the reference writes them). Stages that
several reports reuse are written once and read back (lineage is cut, and a
lost executor recomputes from those files, not from the raw input).

Run with spark-submit::

    spark-submit --py-files taxalake.zip taxalake/plans/jobs.py build-graph --dump latest-all.json.bz2 --out /data/wd
    python -m taxalake.plans.jobs analyze --wd-links ... --ott ... --globi-map ... --out ...
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalake.functions.casts import ITEM_COLUMNS, ITEM_RULES, SUBJECT_COLUMNS, SUBJECT_RULES
from taxalake.operators import catalog as CT
from taxalake.operators import entities as EN
from taxalake.operators import linkgraph as LG
from taxalake.operators import merge as MG
from taxalake.operators import validate as V
from taxalake.operators.sideload import bernoulli_sample, sideload_text
from taxalake.sinks import snapshot as SN
from taxalake.sources import raster as RS
from taxalake.sources.delimited import read_delimited, read_pipe_table, read_quoted_table, row_order
from taxalake.sources.text import read_lines, read_texts


def _out(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


# ---------------------------------------------------------------- taxon graph: build


def build_taxon_graph(
    spark: SparkSession,
    dump: str,
    out: str,
    multi_claims: str = "strict",
    deep_keys: str = "strict",
    single_file_reports: bool = False,
) -> dict[str, str]:
    """Entity dump -> taxonInfo.parquet (terms) -> taxonLinks.parquet -> reports."""
    terms = SN.materialize(
        EN.terms_from_lines(read_lines(spark, dump), multi_claims=multi_claims, deep_keys=deep_keys),
        _out(out, "taxonInfo.parquet"),
    )
    SN.materialize(EN.entity_links(terms), _out(out, "taxonLinks.parquet"))
    paths = {"terms": _out(out, "taxonInfo.parquet"), "links": _out(out, "taxonLinks.parquet")}
    for name, column in (("duplicateNames", "names"), ("duplicateRanks", "rankIds"), ("duplicateParentIds", "parentIds")):
        paths[name] = SN.export_delimited(
            EN.multi_valued(terms, column), _out(out, f"{name}.csv"), sep=",", header=False, single_file=single_file_reports
        )
    paths["sameAsIdsStats"] = SN.export_delimited(
        EN.same_as_histogram(terms), _out(out, "sameAsIdsStats.csv"), sep=",", header=False, single_file=True
    )
    return paths


# ---------------------------------------------------------------- taxon graph: merge


def merge_taxon_graphs(
    spark: SparkSession, terms_path: str, taxon_map: str, taxon_cache: str, out: str, single_file: bool = False
) -> dict[str, str]:
    """WD terms + GloBI taxon map/cache -> merged, sorted header TSVs."""
    terms = spark.read.parquet(terms_path)
    gmap = read_delimited(spark, taxon_map, sep="\t", header=True)
    gcache = read_delimited(spark, taxon_cache, sep="\t", header=True)
    cache_path = SN.export_delimited(
        MG.merge_cache(gcache, terms), _out(out, "taxonCache.tsv"), sort_by=["id", "name"], single_file=single_file
    )
    map_path = SN.export_delimited(
        MG.merge_map(gmap, terms), _out(out, "taxonMap.tsv"), sort_by=list(MG.MAP_COLUMNS), single_file=single_file
    )
    return {"taxonCache": cache_path, "taxonMap": map_path}


# ---------------------------------------------------------------- taxon graph: analyze


def analyze_taxon_graphs(
    spark: SparkSession,
    wd_links: str,
    ott_taxonomy: str,
    globi_map: str,
    out: str,
    schemes=LG.DEFAULT_SCHEMES,
    joined_exports: bool = False,
    with_composites: bool = False,
) -> dict[str, str]:
    """Three graphs -> links -> coverage, Venn breakdowns, conflicts.

    The link union and the per-id profile are written once and every report
    reads them back. Conflicts are found by composite signature, so no
    composite key string is built except for the exported (short) keys;
    ``with_composites=True`` also writes every composite with its full key.
    ``joined_exports=True`` writes the conflict exports in the reference's
    shape (ids of a composite joined with ``|`` on one line); the default
    writes one row per (composite, id).
    """
    wd = spark.read.parquet(wd_links).toDF("entity", "ext")
    ott = read_pipe_table(spark, ott_taxonomy)
    ott = ott.toDF(*(["uid"] + ott.columns[1:4] + ["sourceinfo"] + ott.columns[5:]))
    gmap = read_delimited(spark, globi_map, sep="\t", header=True)
    links = SN.materialize(
        LG.link_union(LG.ott_links(ott), LG.wd_links(wd), LG.globi_links(gmap)), _out(out, "links.parquet")
    )
    SN.export_delimited(links, _out(out, "links-globi-wd-ott.tsv"), header=False)
    profile = SN.materialize(LG.id_profile(links, schemes), _out(out, "idProfile.parquet"))
    paths = {"links": _out(out, "links.parquet"), "profile": _out(out, "idProfile.parquet")}
    reports: dict[str, DataFrame] = {
        "linksBySourceScheme": LG.links_by_source_scheme(links, schemes),
        "coverage": LG.coverage_report(profile),
        "vennByScheme": LG.venn_by_scheme(profile),
        "idsByScheme": LG.ids_by_scheme(profile),
    }
    terms = SN.materialize(LG.term_counts(links, schemes), _out(out, "termCounts.parquet"))
    sigs = SN.materialize(LG.composite_signatures(links, schemes), _out(out, "compositeSignatures.parquet"))
    stats = SN.materialize(LG.signature_stats(sigs, schemes), _out(out, "compositeStats.parquet"))
    reports["conflictsByKeyLength"] = (
        stats.where("repeats > 0").groupBy("key_length").count().withColumnRenamed("count", "n_composites")
    )
    if with_composites:
        reports["composites"] = LG.composites(links, schemes)
    for name, df in reports.items():
        paths[name] = _out(out, f"{name}.parquet")
        df.write.mode("overwrite").parquet(paths[name])
    for name, klen in (("duplicatesWithCompositeKeyPair", 2), ("duplicatesWithCompositeKeySingleton", 1)):
        members = LG.short_members(sigs, stats, klen, terms)
        rows = LG.pipe_joined_ids(members).select("composite", "ids", "repeats", "key_length") if joined_exports else members
        paths[name] = SN.export_delimited(rows, _out(out, f"{name}.tsv"), header=False)
    return paths


# ---------------------------------------------------------------- library items


def ingest_items(
    spark: SparkSession,
    item_dump: str,
    mirror: str | None,
    out: str,
    budget: int = 50,
    on_exceed: str = "keep",
    sample: float | None = None,
    subjects: str | None = None,
) -> dict[str, str]:
    """Item dump -> typed, validated rows -> OCR text side-load -> Parquet. Every good row is
    kept unless ``on_exceed`` says otherwise (see ``validate.apply_error_budget``).

    The output must not exist yet (rerun guard). Rejected rows are written
    next to it with their failing columns.
    """
    raw = read_quoted_table(spark, item_dump, list(ITEM_COLUMNS))
    typed = V.type_rows(raw.withColumn("rn", row_order(raw)), ITEM_RULES, keep=("rn",))
    good = V.apply_error_budget(typed, "rn", budget, on_exceed).drop("rn")
    if sample is not None:
        good = bernoulli_sample(good, sample)
    if mirror:
        good = sideload_text(good, read_texts(spark, mirror, null_on_bad_utf8=True), key="barcode")
    paths = {"items": SN.write_snapshot(good, out)}
    rejects = V.bad_rows(typed).select(F.col("rn._file").alias("file"), F.col("rn._row").alias("row"), "reason")
    paths["rejects"] = SN.write_snapshot(rejects, out.rstrip("/") + "-rejects")
    if subjects:
        sraw = read_quoted_table(spark, subjects, list(SUBJECT_COLUMNS))
        st = V.type_rows(sraw.withColumn("rn", row_order(sraw)), SUBJECT_RULES, keep=("rn",))
        paths["subjects"] = SN.write_snapshot(V.apply_error_budget(st, "rn", budget, on_exceed).drop("rn"), out.rstrip("/") + "-subjects")
    return paths


# ---------------------------------------------------------------- specimen records


def load_records(
    spark: SparkSession,
    src: str,
    base: str,
    name: str,
    stamp: str,
    fmt: str = "parquet",
    meta: str | None = None,
    where: dict | None = None,
    exclude=CT.BAD_RECORD_FIELDS,
    overwrite: bool = False,
    schema=None,
) -> dict[str, str]:
    """Records -> projected (field list from metadata, bad fields left out),
    filtered -> full snapshot + 100k and 1M editions.

    Give ``schema`` for JSON or CSV sources: schema inference reads all data.
    """
    fields = None
    if meta:
        docs = spark.read.text(meta, wholetext=True)
        fields = [r.field for r in CT.catalog_fields(docs).collect()]  # a field list: tiny, metadata only
        r = spark.read.format(fmt)
        df_cols = set((r.schema(schema) if schema is not None else r).load(src).columns)
        fields = [f for f in fields if f.split(".", 1)[0] in df_cols]
    df = CT.read_records(spark, src, fields=fields, where=where, exclude=exclude, fmt=fmt, schema=schema)
    return SN.write_editions(df, base, name, stamp, overwrite=overwrite)


# ---------------------------------------------------------------- elevation


def convert_elevation(spark: SparkSession, src: str, out: str, samples: int = RS.SAMPLES, convention: str = "reference") -> dict[str, str]:
    """All tiles -> one Parquet table of cells, plus the rejected files."""
    cells = RS.decode_tiles(spark, src, samples=samples, convention=convention)
    paths = {"cells": SN.write_snapshot(cells, out)}
    paths["rejects"] = SN.write_snapshot(RS.tile_rejects(RS.tile_files(spark, src), samples), out.rstrip("/") + "-rejects")
    return paths


# ---------------------------------------------------------------- command line


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="taxalake.plans.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    b = sub.add_parser("build-graph")
    b.add_argument("--dump", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--multi-claims", default="strict", choices=["strict", "all"])
    b.add_argument("--deep-keys", default="strict", choices=["claims", "strict"])
    m = sub.add_parser("merge")
    m.add_argument("--terms", required=True)
    m.add_argument("--taxon-map", required=True)
    m.add_argument("--taxon-cache", required=True)
    m.add_argument("--out", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("--wd-links", required=True)
    a.add_argument("--ott", required=True)
    a.add_argument("--globi-map", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--joined-exports", action="store_true")
    a.add_argument("--with-composites", action="store_true", help="also write every composite with its full key")
    i = sub.add_parser("ingest-items")
    i.add_argument("--items", required=True)
    i.add_argument("--mirror")
    i.add_argument("--subjects")
    i.add_argument("--out", required=True)
    i.add_argument("--budget", type=int, default=50)
    i.add_argument("--on-exceed", default="keep", choices=["keep", "fail", "truncate"], help="beyond the budget of bad rows")
    i.add_argument("--sample", type=float)
    r = sub.add_parser("load-records")
    r.add_argument("--src", required=True)
    r.add_argument("--format", default="parquet")
    r.add_argument("--meta")
    r.add_argument("--base", required=True)
    r.add_argument("--name", required=True)
    r.add_argument("--stamp", required=True)
    r.add_argument("--where", help='JSON object of exact terms, e.g. {"genus": "acer"}')
    r.add_argument("--load", default="records", choices=sorted(CT.BAD_FIELDS), help="whose list of bad fields is left out")
    r.add_argument("--schema", help="DDL schema of the source (avoids inference over JSON/CSV)")
    e = sub.add_parser("elevation")
    e.add_argument("--src", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--convention", default="reference", choices=["reference", "sw_corner"])
    args = p.parse_args(argv)

    from taxalake.session import job_session

    spark = job_session(f"taxalake-{args.job}")
    if args.job == "build-graph":
        res = build_taxon_graph(spark, args.dump, args.out, args.multi_claims, args.deep_keys)
    elif args.job == "merge":
        res = merge_taxon_graphs(spark, args.terms, args.taxon_map, args.taxon_cache, args.out)
    elif args.job == "analyze":
        res = analyze_taxon_graphs(
            spark, args.wd_links, args.ott, args.globi_map, args.out,
            joined_exports=args.joined_exports, with_composites=args.with_composites,
        )
    elif args.job == "ingest-items":
        res = ingest_items(
            spark, args.items, args.mirror, args.out, args.budget, args.on_exceed, sample=args.sample, subjects=args.subjects
        )
    elif args.job == "load-records":
        where = json.loads(args.where) if args.where else None
        exclude = CT.BAD_FIELDS[args.load]
        res = load_records(
            spark, args.src, args.base, args.name, args.stamp, fmt=args.format, meta=args.meta, where=where,
            exclude=exclude, schema=args.schema,
        )
    else:
        res = convert_elevation(spark, args.src, args.out, convention=args.convention)
    print(json.dumps(res))


if __name__ == "__main__":
    main(sys.argv[1:])
