"""End-to-end jobs on small inputs built from the test tables."""

import json

from pyspark.sql import functions as F

from conftest import SF_SMALL
from taxalake.plans import adapters as A
from taxalake.plans import jobs as J
from taxalake.sinks.snapshot import export_delimited


def test_build_merge_analyze(spark, tmp_path):
    dump = str(tmp_path / "dump")
    A.entity_dump_lines(spark, SF_SMALL).write.text(dump)
    built = J.build_taxon_graph(spark, dump, str(tmp_path / "wd"))
    terms = spark.read.parquet(built["terms"])
    assert terms.count() > 0 and set(terms.columns) == {"id", "names", "rankIds", "parentIds", "sameAsIds"}
    gmap = str(tmp_path / "taxonMap.tsv")
    export_delimited(A.resolver_map(spark, SF_SMALL), gmap)
    gcache = str(tmp_path / "taxonCache.tsv")
    export_delimited(A.resolver_cache(spark, SF_SMALL), gcache)
    merged = J.merge_taxon_graphs(spark, built["terms"], gmap, gcache, str(tmp_path / "merged"))
    assert spark.read.option("sep", "\t").option("header", True).csv(merged["taxonMap"]).count() > 0
    ott = tmp_path / "taxonomy.tsv"
    rows = ["uid\t|\tparent_uid\t|\tname\t|\trank\t|\tsourceinfo\t|\tuniqname\t|\tflags\t|\t"]
    rows += [f"{k}\t|\t\t|\tt{k}\t|\tspecies\t|\tncbi:{k * 2},gbif:{k * 3}\t|\t\t|\t\t|\t" for k in range(1, 200)]
    ott.write_text("\n".join(rows) + "\n")
    g2 = str(tmp_path / "globiMap.tsv")
    export_delimited(A.globi_taxon_map(spark, SF_SMALL), g2)
    res = J.analyze_taxon_graphs(
        spark, built["links"], str(ott), g2, str(tmp_path / "an"), joined_exports=True, with_composites=True
    )
    assert spark.read.parquet(res["composites"]).count() > 0
    cov = spark.read.parquet(res["coverage"]).collect()[0]
    assert cov.total_ids > 0 and cov.all_three > 0
    pair = spark.read.option("sep", "\t").csv(res["duplicatesWithCompositeKeySingleton"])
    assert pair.columns == ["_c0", "_c1", "_c2", "_c3"]


def test_ingest_items_and_records(spark, tmp_path):
    raw = A.raw_items(spark, SF_SMALL).drop("rn")
    dump = str(tmp_path / "item.txt")
    export_delimited(raw, dump)
    mirror = tmp_path / "mirror"
    mirror.mkdir()
    (mirror / "bc1_djvu.txt").write_text("text one")
    res = J.ingest_items(spark, dump, str(mirror), str(tmp_path / "bhl.parquet"))
    items = spark.read.parquet(res["items"])
    assert "ocrtext" in items.columns
    assert items.where(F.col("barcode") == "bc1").select("ocrtext").collect()[0].ocrtext == "text one"
    assert spark.read.parquet(res["rejects"]).count() > 0
    src = str(tmp_path / "records.parquet")
    A.records(spark, SF_SMALL).write.parquet(src)
    meta = tmp_path / "meta.json"
    meta.write_text(json.dumps({"uuid": {"fieldName": "uuid", "type": "string"}, "genus": {"fieldName": "genus", "type": "string"},
                                "commonnames": {"fieldName": "commonnames", "type": "string"},
                                "data": {"dwc:eventDate": {"fieldName": "data.dwc:eventDate", "type": "string"}}}))
    ed = J.load_records(spark, src, str(tmp_path / "out"), "idigbio", "20240101T000000", meta=str(meta), where={"genus": "CLICK"})
    full = spark.read.parquet(ed["all"])
    assert set(full.columns) == {"uuid", "genus", "data.dwc:eventDate"} and full.count() > 0
    assert spark.read.parquet(ed["100k"]).count() == full.count()


def test_cli_elevation_and_records(spark, tmp_path, capsys):
    import numpy as np

    d = tmp_path / "dem3"
    d.mkdir()
    (d / "N10E020.hgt").write_bytes(np.arange(1201 * 1201, dtype=np.int64).astype(">i2").tobytes())
    (d / "bad.hgt").write_bytes(b"\x00" * 10)
    out = str(tmp_path / "elevation.parquet")
    J.main(["elevation", "--src", str(d), "--out", out])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert spark.read.parquet(res["cells"]).count() == 1201 * 1201
    assert [r.reason for r in spark.read.parquet(res["rejects"]).collect()] == ["bad name"]
    src = str(tmp_path / "media.parquet")
    A.records(spark, SF_SMALL).write.parquet(src)
    J.main(["load-records", "--src", src, "--base", str(tmp_path / "m"), "--name", "idigbio-media",
            "--stamp", "20240101T000000", "--where", '{"genus": "view"}', "--load", "media"])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    full = spark.read.parquet(res["all"])
    assert "commonnames" in full.columns and "uuid" in full.columns  # the media list keeps the common names
    assert full.where(F.col("genus") != "view").count() == 0
