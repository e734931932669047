"""Entity dump -> terms -> links: selection rules on a hand-made dump."""

import json

import pytest
from pyspark.sql import functions as F

from taxalake.operators import entities as EN
from taxalake.operators import merge as MG
from taxalake.plans import adapters as A
from taxalake.sources.text import read_lines


def snak(value):
    return {"mainsnak": {"snaktype": "value", "datavalue": {"value": value, "type": "x"}}, "type": "statement"}


def item(q):
    return {"entity-type": "item", "numeric-id": int(q[1:]), "id": q}


TAXON = [snak(item("Q16521"))]


def entity(qid, claims, **extra):
    return {"type": "item", "id": qid, "claims": claims, **extra}


def dump_lines():
    ents = [
        entity("Q140", {"P31": TAXON, "P685": [snak("9689")], "P846": [snak("5219404")], "P225": [snak("Panthera leo")],
                        "P105": [snak(item("Q7432"))], "P171": [snak(item("Q127960"))]}),
        entity("Q2", {"P31": TAXON + TAXON, "P685": [snak("2")]}),  # two P31 claims
        entity("Q3", {"P31": [snak(item("Q5"))], "P279": [snak(item("Q16521"))], "P685": [snak("3")]}),
        entity("Q5", {"P31": TAXON, "P846": [snak("1"), snak("2")], "P685": [snak("55")]}),  # two GBIF claims
        entity("Q6", {"P31": TAXON, "P685": [{"mainsnak": {"snaktype": "novalue"}}], "P846": [snak("6")]}),
        entity("Q7", {"P31": TAXON, "P225": [snak("a"), snak("[Clostridium] b")], "P846": [snak("7")]}),  # two names, no rank
        entity("Q9", {"P31": TAXON, "P225": [snak({"text": "x", "language": "en"})], "P846": [snak("9")]}),  # non-string name
        entity("Q8", {"P31": TAXON, "P105": [dict(snak(item("Q7432")), qualifiers={"P105": [snak(item("Q1"))]})],
                      "P846": [snak("8")]}),  # rank key also inside a qualifier
    ]
    lines = ["["] + [json.dumps(e) + "," for e in ents]
    lines.insert(3, '{"type":"item","id":"Q165210","claims":{}},')  # only Q165210: dropped by the prefilter
    return lines + ["]"]


@pytest.fixture()
def dump(spark, tmp_path):
    p = tmp_path / "dump.json"
    p.write_text("\n".join(dump_lines()) + "\n")
    return read_lines(spark, str(p))


def terms(dump, **kw):
    return {r.id: r for r in EN.terms_from_lines(dump, **kw).collect()}


def test_prefilter(dump):
    ids = [r.line.split('"id": "')[1].split('"')[0] for r in EN.prefilter_lines(dump).collect()]
    assert "Q165210" not in ids and "Q3" in ids
    assert all(not r.line.endswith(",") for r in EN.prefilter_lines(dump).collect())


def test_strict_rules(dump):
    t = terms(dump)
    assert set(t) == {"Q140", "Q5", "Q6", "Q7", "Q8", "Q9"}  # Q2 (two P31) and Q3 (not a taxon) drop
    assert t["Q140"].sameAsIds == ["NCBI:9689", "GBIF:5219404"]
    assert t["Q140"].names == ["Panthera leo"] and t["Q140"].rankIds == ["Q7432"] and t["Q140"].parentIds == ["Q127960"]
    assert t["Q5"].sameAsIds == ["NCBI:55"]  # two GBIF claims give none
    assert t["Q6"].sameAsIds == ["GBIF:6"]  # a claim without a value gives nothing
    assert t["Q7"].names == ["a", "[Clostridium] b"] and t["Q7"].rankIds == []
    assert t["Q9"].names == []
    assert t["Q8"].rankIds == []  # key found twice: empty, as a deep search gives


def test_lax_and_deep_rules(dump):
    t = terms(dump, multi_claims="all", deep_keys="claims")
    assert "Q2" in t and t["Q2"].sameAsIds == ["NCBI:2"]
    assert t["Q5"].sameAsIds == ["NCBI:55", "GBIF:1"]
    assert t["Q8"].rankIds == ["Q7432"]  # claims mode reads the claim only


def test_links_and_reports(dump):
    tt = EN.terms_from_lines(dump)
    links = {(r.entity, r.ext) for r in EN.entity_links(tt).collect()}
    assert ("Q140", "NCBI:9689") in links
    names = {r.id: (r.n_values, r.joined) for r in EN.multi_valued(tt, "names").collect()}
    assert names == {"Q7": (2, "a|[Clostridium] b")}
    hist = {r.n_ids: r.n_entities for r in EN.same_as_histogram(tt).collect()}
    assert hist == {2: 1, 1: 5}


def test_malformed_line_fails(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('{"id": "Q1", "claims": {"P31": [' + json.dumps(snak(item("Q16521"))) + "]}},\n"
                 '{"id": "Q2", "claims": {"P31": [{"x": "Q16521"} ,\n')
    with pytest.raises(Exception):
        EN.terms_from_lines(read_lines(spark, str(p))).collect()
    ok = EN.terms_from_lines(read_lines(spark, str(p)), mode="PERMISSIVE").collect()
    assert [r.id for r in ok] == ["Q1"]


def test_cache_rows_paths(dump):
    tt = EN.terms_from_lines(dump)
    rows = {r.id: r for r in MG.cache_from_terms(tt).collect()}
    assert set(rows) == {"WD:Q140"}  # the only term with names, ids and a rank
    r = rows["WD:Q140"]
    assert r.path == " | Panthera leo" and r.pathIds == "WD:Q127960 | WD:Q140"
    assert r.pathNames == " | WD:Q7432" and r.externalUrl.endswith("/Q140") and r.commonNames == ""


def test_malformed_lines_cost_themselves(spark):
    from taxalake.operators import entities as EN

    lines = [(1, '{"id":"Q1","claims":{}}'), (2, '{"id":"Q2","cla'), (3, ""), (4, None), (5, "[1]"), (6, '{"id":"Q6","claims":"none"}'), (7, '{"id":"Q7"}')]
    good, bad = EN.split_malformed(spark.createDataFrame(lines, "entity long, line string"))
    assert sorted(r.entity for r in good.collect()) == [1, 7]
    assert {r.entity: r.reason for r in bad.collect()} == {2: "no JSON object", 3: "empty", 4: "empty", 5: "no JSON object", 6: "other types"}
    assert sorted(r.id for r in EN.parse_entities(good).select("e.id").collect()) == ["Q1", "Q7"]


def test_lines_of_a_small_file_are_spread_over_tasks(spark, tmp_path):
    n = 5000
    part = spark.range(1, n + 1).selectExpr(
        "nullif(id, 7) AS p_partkey", "concat('name ', id) AS p_name", "'type' AS p_type", "cast(id % 50 AS int) AS p_size"
    )
    part = part.unionByName(part.where("p_partkey = 3"))  # a key twice; a null key (no id: the first one in the line is the taxon class)
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    lines = A.entity_dump_lines(spark, str(tmp_path))
    tasks = min(spark.sparkContext.defaultParallelism, n // 1000)
    sizes = [r["count"] for r in lines.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n + 1 and len(sizes) == tasks and max(sizes) < 2 * n / tasks
    by_id = {r.entity: r["count"] for r in lines.select(F.regexp_extract("value", '"id":"(Q[0-9]+)"', 1).alias("entity")).groupBy("entity").count().collect()}
    assert by_id == {**{f"Q{i}": 1 for i in range(1, n + 1) if i != 7}, "Q3": 2, "Q16521": 1}
