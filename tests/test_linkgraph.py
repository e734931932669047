"""Link graph: builders, coverage identities, composites, golden conflicts."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from taxalake.functions.ids import java_split, java_trim, key_length, prefix_repeats
from taxalake.operators import linkgraph as LG
from taxalake.sources.delimited import read_pipe_table

# Fixed values from the reference's golden conflict export (composite key,
# ids joined by "|", repeats, key length): three of its 56 rows.
GOLDEN = [
    (
        "GLOBI:bioinfo:taxon:160471@Fusarium oxysporum f.sp. narcissi|OTT:404217",
        "IF:218372|NCBI:330941|NCBI:59765|NCBI:61369|NCBI:62683|NCBI:120042|NCBI:120297|NCBI:61364|"
        "NCBI:96317|NCBI:61374|NCBI:96318|NCBI:42551|NCBI:100902|NCBI:61370|NCBI:120040",
        13,
        2,
    ),
    ("GLOBI:INAT_TAXON:181928@Avicennia marina australasica|OTT:61444", "WORMS:742480|WORMS:709272", 1, 2),
    ("GLOBI:26418@Herpetomonas|OTT:222232", "GBIF:7560242|WORMS:601698|WORMS:562572|NCBI:5714", 1, 2),
]


def test_golden_rule_from_columns(spark):
    df = spark.createDataFrame(GOLDEN, "key string, ids string, repeats int, key_len int")
    out = df.select(
        prefix_repeats(F.split("ids", r"\|")).alias("r"), key_length(F.col("key")).alias("k"), "repeats", "key_len"
    ).collect()
    for row in out:
        assert row.r == row.repeats and row.k == row.key_len


def test_golden_rows_rebuilt_from_links(spark):
    links = []
    for key, ids, _, _ in GOLDEN:
        for ext in ids.split("|"):
            for term in key.split("|"):
                links.append((ext, term))
    df = spark.createDataFrame(links, "ext string, term string")
    comps = LG.composites(df)
    stats = LG.composite_stats(comps)
    got = {
        (r.composite, r.repeats, r.key_length)
        for r in stats.where((F.col("repeats") > 0) & (F.col("key_length") == 2)).collect()
    }
    assert got == {(k, r, n) for k, _, r, n in GOLDEN}
    members = LG.pipe_joined_ids(LG.conflict_members(comps, stats, 2)).collect()
    for r in members:
        want = next(g for g in GOLDEN if g[0] == r.composite)
        assert sorted(r.ids.split("|")) == sorted(want[1].split("|"))


def test_composites_keep_duplicate_terms(spark):
    links = [
        ("NCBI:1", "OTT:1"),
        ("NCBI:1", "OTT:1"),
        ("NCBI:1", "WD:Q1"),
        ("NCBI:1", "GLOBI:a@x"),
        ("NCBI:1", "GLOBI:a@x"),
        ("NCBI:1", "GLOBI:b@y"),
        ("GBIF:2", "GLOBI:a@x"),
        ("ITIS:3", "GLOBI:a@x"),  # not whitelisted
        ("WORMS:4", "OTT:9"),  # no GLOBI term: no composite
    ]
    df = spark.createDataFrame(links, "ext string, term string")
    got = {(r.ext, r.composite, r.n_links) for r in LG.composites(df).collect()}
    assert got == {
        ("NCBI:1", "GLOBI:a@x|OTT:1|OTT:1|WD:Q1", 2),
        ("NCBI:1", "GLOBI:b@y|OTT:1|OTT:1|WD:Q1", 1),
        ("GBIF:2", "GLOBI:a@x", 1),
    }


def test_coverage_identities(spark):
    from taxalake.plans.catalogue import links_of

    prof = LG.id_profile(links_of(spark, SF_SMALL))
    r = LG.coverage_report(prof).collect()[0].asDict()
    venn = {(x.region, x.scheme): x.n_ids for x in LG.venn_by_scheme(prof).collect()}
    regions = {}
    for (reg, _), n in venn.items():
        regions[reg] = regions.get(reg, 0) + n
    assert sum(regions.values()) == r["total_ids"]
    assert len(regions) == 7  # every region is populated
    assert regions["GLOBI+OTT+WD"] == r["all_three"]
    assert regions["GLOBI"] == r["only_globi"] and regions["OTT"] == r["only_ott"] and regions["WD"] == r["only_wd"]
    assert r["ott_and_wd"] == regions["OTT+WD"] + regions["GLOBI+OTT+WD"]
    assert r["has_globi"] == sum(n for k, n in regions.items() if "GLOBI" in k)
    assert r["has_ott"] == sum(n for k, n in regions.items() if "OTT" in k)
    assert r["has_wd"] == sum(n for k, n in regions.items() if "WD" in k)
    assert r["no_globi"] == r["total_ids"] - r["has_globi"]
    assert r["two_no_globi"] == regions["OTT+WD"]
    assert r["two_no_ott"] == regions["GLOBI+WD"]
    assert r["two_no_wd"] == regions["GLOBI+OTT"]
    by_scheme = {x.scheme: x.n_ids for x in LG.ids_by_scheme(prof).collect()}
    assert sum(by_scheme.values()) == r["total_ids"]


def test_java_split_and_trim(spark):
    rows = [("a,b,,",), (",",), ("",), ("a",), (",a",), ("a,,b",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    got = [r.x for r in df.select(java_split(F.col("v"), ",").alias("x")).collect()]
    # what java.lang.String.split(",") returns
    assert got == [["a", "b"], [], [""], ["a"], ["", "a"], ["a", "", "b"], None]
    t = spark.createDataFrame([("\t x \x01",)], "v string").select(java_trim("v").alias("t")).collect()[0].t
    assert t == "x"


def test_taxonomy_table_links(spark, tmp_path):
    p = tmp_path / "taxonomy.tsv"
    header = "uid\t|\tparent_uid\t|\tname\t|\trank\t|\tsourceinfo\t|\tuniqname\t|\tflags\t|\t"
    rows = [
        "1\t|\t\t|\tlife\t|\tno rank\t|\tncbi:1,gbif:2\t|\t\t|\t\t|\t",
        "2\t|\t1\t|\tx\t|\tspecies\t|\tncbi:3\t|\t\t|\t\t|\t",
        "3\t|\t1\t|\ty\t|\tspecies\t|\t\t|\t\t|\t\t|\t",
        "4\t|\t1\t|\tz\t|\tspecies\t|\tsilva:x,worms:3\t|\t\t|\t\t|\t",
    ]
    p.write_text("\n".join([header] + rows) + "\n")
    t = read_pipe_table(spark, str(p))
    assert t.columns[:5] == ["uid", "parent_uid", "name", "rank", "sourceinfo"]
    links = {(r.ext, r.term) for r in LG.ott_links(t).collect()}
    # a blank sourceinfo is text, not null: Java split + trim give one empty id
    assert links == {
        ("", "OTT:3"),
        ("NCBI:1", "OTT:1"),
        ("GBIF:2", "OTT:1"),
        ("NCBI:3", "OTT:2"),
        ("SILVA:X", "OTT:4"),
        ("WORMS:3", "OTT:4"),
    }


def test_null_sourceinfo_gives_no_link(spark):
    df = spark.createDataFrame([("1", None), ("2", "ncbi:1")], "uid string, sourceinfo string")
    assert {(r.ext, r.term) for r in LG.ott_links(df).collect()} == {("NCBI:1", "OTT:2")}


def test_globi_links_null_printing(spark):
    rows = [
        (None, "Homo", "NCBI:9606", "x"),
        ("EOL:1", None, "GBIF:1", "x"),
        ("EOL:2", "a", None, "x"),
        ("EOL:3", "b", "OTT:5", "x"),
        ("EOL:4", "c", "WD:Q5", "x"),
    ]
    df = spark.createDataFrame(rows, "providedTaxonId string, providedTaxonName string, resolvedTaxonId string, resolvedTaxonName string")
    got = {(r.ext, r.term) for r in LG.globi_links(df).collect()}
    assert got == {("NCBI:9606", "GLOBI:null@Homo"), ("GBIF:1", "GLOBI:EOL:1@null")}


def test_links_by_source_scheme_counts_links(spark):
    df = spark.createDataFrame(
        [("NCBI:1", "OTT:1"), ("NCBI:1", "OTT:1"), ("NCBI:2", "WD:Q1"), ("EOL:1", "OTT:1")], "ext string, term string"
    )
    got = {(r.source, r.scheme, r.n_links) for r in LG.links_by_source_scheme(df).collect()}
    assert got == {("OTT", "NCBI", 2), ("WD", "NCBI", 1)}
