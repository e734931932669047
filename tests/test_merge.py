"""Merge: resolver TSVs, cache union, rewired map."""

import bz2

from taxalake.operators import entities as EN
from taxalake.operators import merge as MG
from taxalake.sources.delimited import read_delimited

MAP_HEADER = "providedTaxonId\tprovidedTaxonName\tresolvedTaxonId\tresolvedTaxonName"
MAP_ROWS = [
    "EOL:1\tPanthera leo\tNCBI:9689\tPanthera leo",
    "\tNo id\tNCBI:9689\tPanthera leo",  # null provided id
    "EOL:2\tGhost\t\t",  # null resolved id
    "EOL:3\tAlready\tOTT:1\tx",
    "EOL:4\tAlready\tWD:Q1\tx",
    "EOL:1\tPanthera leo\tNCBI:9689\tPanthera leo",  # duplicate row
]
CACHE_HEADER = "id\tname\trank\tcommonNames\tpath\tpathIds\tpathNames\texternalUrl\tthumbnailUrl"
CACHE_ROWS = ["NCBI:9689\tPanthera leo\tspecies\t\tPanthera leo\tNCBI:9689\tspecies\t\t"]


def write_bz2(path, header, rows):
    path.write_bytes(bz2.compress(("\n".join([header] + rows) + "\n").encode()))
    return str(path)


def terms(spark):
    rows = [
        ("Q140", ["Panthera leo"], ["Q7432"], ["Q127960"], ["NCBI:9689", "GBIF:5219404"]),
        ("Q2", [], ["Q7432"], [], ["NCBI:2"]),  # no name: left out
    ]
    return spark.createDataFrame(rows, "id string, names array<string>, rankIds array<string>, parentIds array<string>, sameAsIds array<string>")


def test_rewire_and_map(spark, tmp_path):
    m = read_delimited(spark, write_bz2(tmp_path / "taxonMap.tsv.bz2", MAP_HEADER, MAP_ROWS))
    rew = {tuple(r) for r in MG.rewire(m, terms(spark)).collect()}
    assert rew == {("EOL:1", "Panthera leo", "WD:Q140", "Panthera leo"), (None, "No id", "WD:Q140", "Panthera leo")}
    assert MG.rewire(m, terms(spark)).count() == 3  # duplicates multiply in the join
    merged = MG.merge_map(m, terms(spark))
    assert merged.count() == 5 + 2  # distinct map rows + distinct rewired rows


def test_cache_union_keeps_null_and_empty_apart(spark, tmp_path):
    c = read_delimited(spark, write_bz2(tmp_path / "taxonCache.tsv.bz2", CACHE_HEADER, CACHE_ROWS))
    assert c.collect()[0].commonNames is None
    merged = MG.merge_cache(c, terms(spark))
    assert merged.count() == 2
    dup = MG.merge_cache(c.union(c), terms(spark))
    assert dup.count() == 2
