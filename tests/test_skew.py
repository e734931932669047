"""A hot id holding a third of all links: results stay exact and whole, and
the heavy steps aggregate map-side before their shuffle."""

from pyspark.sql import functions as F

from taxalake.operators import linkgraph as LG
from taxalake.operators import merge as MG


def hot_links(spark, n_cold=2000):
    # cold ids: one OTT and one GLOBI link each; hot id: a third of all links
    cold = spark.range(n_cold).select(
        F.concat(F.lit("GBIF:"), F.col("id").cast("string")).alias("ext"),
        F.explode(F.array(F.concat(F.lit("OTT:"), (F.col("id") % 7).cast("string")),
                          F.concat(F.lit("GLOBI:g"), (F.col("id") % 5).cast("string"), F.lit("@x")))).alias("term"),
    )
    hot = spark.range(2 * n_cold).select(
        F.lit("NCBI:1").alias("ext"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("GLOBI:h"), (F.col("id") % 3).cast("string"), F.lit("@y")))
        .otherwise(F.concat(F.lit("OTT:"), (F.col("id") % 2).cast("string"))).alias("term"),
    )
    return cold.unionByName(hot)


def test_profile_with_hot_id(spark):
    links = hot_links(spark)
    prof = {r.ext: r for r in LG.id_profile(links).collect()}
    assert len(prof) == 2001
    assert prof["NCBI:1"].n_links == 4000 and prof["NCBI:1"].n_sources == 2
    plan = LG.id_profile(links)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan  # combined map-side before the shuffle


def test_composites_with_hot_id(spark):
    comps = LG.composites(hot_links(spark))
    hot = comps.where(F.col("ext") == "NCBI:1").collect()
    assert len(hot) == 3  # one composite per distinct GLOBI term
    assert sum(r.n_links for r in hot) == 1000
    key = hot[0].composite.split("|")
    assert len(key) == 3001 and key.count("OTT:0") == 1000 and key.count("OTT:1") == 2000
    stats = LG.composite_stats(comps)
    assert stats.where(F.col("composite") == hot[0].composite).collect()[0].n_ids == 1
    # cold composites: 35 combinations of OTT and GLOBI terms; every id in one
    cold = stats.where(F.col("key_length") == 2)
    assert cold.agg(F.sum("n_ids")).collect()[0][0] == 2000


def test_rewire_hot_resolved_id(spark):
    gmap = spark.range(3000).select(
        F.concat(F.lit("EOL:"), F.col("id").cast("string")).alias("providedTaxonId"),
        F.lit("n").alias("providedTaxonName"),
        F.when(F.col("id") % 3 == 0, F.lit("NCBI:1")).otherwise(F.concat(F.lit("GBIF:"), F.col("id").cast("string"))).alias("resolvedTaxonId"),
        F.lit("r").alias("resolvedTaxonName"),
    )
    terms = spark.createDataFrame(
        [("Q1", ["a"], ["Q7432"], [], ["NCBI:1", "GBIF:2"])],
        "id string, names array<string>, rankIds array<string>, parentIds array<string>, sameAsIds array<string>",
    )
    out = MG.rewire(gmap, terms)
    assert out.count() == 1000 + 1  # every row of the hot id, plus GBIF:2


def test_signature_path_with_hub(spark):
    """A hub id with 300 GLOBI terms and 3000 distinct other terms: the
    signature path builds no key strings and agrees with the string path."""
    hub_g = spark.range(300).select(F.lit("NCBI:7").alias("ext"), F.concat(F.lit("GLOBI:h"), F.col("id").cast("string"), F.lit("@z")).alias("term"))
    hub_o = spark.range(3000).select(F.lit("NCBI:7").alias("ext"), F.concat(F.lit("OTT:"), F.col("id").cast("string")).alias("term"))
    links = hot_links(spark).unionByName(hub_g).unionByName(hub_o)
    fast = sorted(map(tuple, LG.conflicts_by_key_length_fast(links).collect()))
    slow = sorted(map(tuple, LG.conflicts_by_key_length(LG.composite_stats(LG.composites(links))).collect()))
    assert fast == slow
    sigs = LG.composite_signatures(links).where(F.col("ext") == "NCBI:7").collect()
    assert len(sigs) == 300 and {r.key_length for r in sigs} == {3001} and {r.n_others for r in sigs} == {3000}
    for k in (1, 2):
        comps = LG.composites(links)
        slow_m = sorted(map(tuple, LG.conflict_members(comps, LG.composite_stats(comps), k).select("composite", "ext", "repeats", "key_length").collect()))
        assert sorted(map(tuple, LG.short_conflict_members(links, k).collect())) == slow_m


def test_signature_path_golden(spark):
    from test_linkgraph import GOLDEN

    links = []
    for key, ids, _, _ in GOLDEN:
        for ext in ids.split("|"):
            for term in key.split("|"):
                links.append((ext, term))
    df = spark.createDataFrame(links, "ext string, term string")
    got = {(r.composite, r.repeats, r.key_length) for r in LG.short_conflict_members(df, 2).collect()}
    assert got == {(k, r, n) for k, _, r, n in GOLDEN}


def test_sideload_null_keys_skip_the_join(spark):
    from taxalake.operators.sideload import sideload_text

    items = spark.range(3000).select(
        F.col("id").alias("itemid"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("bc"), F.col("id").cast("string"))).alias("barcode"),
    )
    texts = spark.range(0, 3000, 2).select(F.concat(F.lit("bc"), F.col("id").cast("string")).alias("barcode"), F.lit("t").alias("text"))
    out = sideload_text(items, texts)
    assert out.count() == 3000
    assert out.where(F.col("barcode").isNull() & F.col("ocrtext").isNull()).count() == 1000
    assert out.where(F.col("ocrtext") == "t").count() == 1000  # even ids not divisible by 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan
