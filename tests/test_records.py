"""Records: projection, term filters, array hints, field catalogues, drift, probes."""

import json

from pyspark.sql import functions as F

from taxalake.operators import catalog as CT

RECORDS = [
    {"uuid": "a", "genus": "Acer", "stateprovince": "Vermont", "individualcount": 2, "datemodified": "2017-06-07T18:37:47",
     "hasimage": True, "commonnames": ["maple"], "flags": ["x"], "data": {"dwc:eventDate": "1999-01-01", "dwc:x": "1"}},
    {"uuid": "b", "genus": "acer", "stateprovince": "florida", "individualcount": 1, "datemodified": "2017-06-07T18:37:47",
     "hasimage": False, "commonnames": ["red maple", "swamp maple"], "flags": [], "data": {"dwc:eventDate": None, "dwc:x": "2"}},
    {"uuid": "c", "genus": "Eucalyptus", "stateprovince": "vermont", "individualcount": 5, "datemodified": None,
     "hasimage": None, "commonnames": None, "flags": None, "data": {"dwc:eventDate": "2001-02-03", "dwc:x": "3"}},
]
SCHEMA = (
    "uuid string, genus string, stateprovince string, individualcount int, datemodified timestamp, hasimage boolean, "
    "commonnames array<string>, flags array<string>, data struct<`dwc:eventDate`: string, `dwc:x`: string>"
)
META = {
    "genus": {"fieldName": "genus", "type": "string"},
    "uuid": {"fieldName": "uuid", "type": "string"},
    "data": {"dwc:eventDate": {"fieldName": "data.dwc:eventDate", "type": "string"}, "dwc:y": {"fieldName": "data.dwc:y", "type": "string"}},
    "other": {"x": {}},
}


def write_records(tmp_path):
    p = tmp_path / "records.json"
    p.write_text("\n".join(json.dumps(r) for r in RECORDS))
    return str(p)


def test_read_records_projection_filter(spark, tmp_path):
    path = write_records(tmp_path)
    fields = ["uuid", "genus", "flags", "data.dwc:eventDate"]
    df = CT.read_records(spark, path, fields=fields, where={"genus": "ACER", "stateprovince": "vermont"}, fmt="json", schema=SCHEMA)
    assert df.columns == ["uuid", "genus", "data.dwc:eventDate"]  # flags is a known-bad field
    assert [(r.uuid, r["data.dwc:eventDate"]) for r in df.collect()] == [("a", "1999-01-01")]


def test_pushdown_to_parquet(spark, tmp_path):
    src = spark.read.schema(SCHEMA).json(write_records(tmp_path))
    pq = str(tmp_path / "records.parquet")
    src.write.parquet(pq)
    df = CT.read_records(spark, pq, fields=["uuid", "data.dwc:eventDate"], where={"uuid": "c"})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<uuid:string,data:struct<dwc:eventDate:string>>" in plan
    assert [r.uuid for r in df.collect()] == ["c"]


def test_array_hint_and_term_on_array(spark, tmp_path):
    df = CT.read_records(spark, write_records(tmp_path), fmt="json", schema=SCHEMA,
                         array_fields=("genus", "commonnames"), where={"commonnames": "Swamp Maple"}, exclude=())
    rows = df.collect()
    assert [r.uuid for r in rows] == ["b"] and rows[0].genus == ["acer"]


def test_boolean_projection_counts_all_rows(spark, tmp_path):
    df = spark.read.schema(SCHEMA).json(write_records(tmp_path))
    assert df.select(F.col("genus") == "Acer").count() == 3


def test_catalogs_and_drift(spark, tmp_path):
    meta = spark.createDataFrame([(json.dumps(META),)], "value string")
    assert {r.field for r in CT.catalog_fields(meta).collect()} == {"genus", "uuid", "data.dwc:eventDate", "data.dwc:y"}
    typed = {(r.field, r.type) for r in CT.catalog_fields(meta, types=True).collect()}
    assert typed == {("genus", "string"), ("uuid", "string"), ("data.dwc:eventDate", "string"),
                     ("data.dwc:y", "string"), ("other", "COMPLEX")}
    df = spark.read.schema(SCHEMA).json(write_records(tmp_path))
    sf = dict(CT.schema_fields(df))
    assert sf["individualcount"] == "integer" and sf["data.dwc:x"] == "string" and sf["datemodified"] == "timestamp"
    drift = {(r.entry, r.only_in) for r in CT.field_drift(CT.catalog_fields(meta, types=True), CT.schema_fields_df(spark, df)).collect()}
    assert ("data.dwc:y::string", "meta") in drift and ("other::COMPLEX", "meta") in drift
    assert ("data.dwc:x::string", "table") in drift and ("genus::string", "meta") not in drift


def test_probe_fields(spark):
    df = spark.createDataFrame([("1", "2020-01-01"), ("x", "2020-13-45"), (" ", None)], "a string, d string")
    got = {r.field: (r.n_present, r.n_bad, r.ok) for r in CT.probe_fields(df, {"a": "int", "d": "date"}).collect()}
    assert got == {"a": (2, 1, False), "d": (2, 1, False)}


def test_json_inventory(spark):
    df = spark.createDataFrame([('{"k": 1, "j": 2}',), ('{"k": 3}',), (None,)], "props string")
    assert {(r.field, r.n_records) for r in CT.json_field_inventory(df, "props").collect()} == {("k", 2), ("j", 1)}


def test_numeric_term_is_pushed(spark, tmp_path):
    pq = str(tmp_path / "r.parquet")
    spark.read.schema(SCHEMA).json(write_records(tmp_path)).write.parquet(pq)
    df = CT.read_records(spark, pq, where={"individualcount": "5", "hasimage": "FALSE"})
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    pushed = [ln for ln in buf.getvalue().splitlines() if ln.startswith("PushedFilters")][0]
    assert "EqualTo(individualcount,5)" in pushed and "hasimage" in pushed
    assert df.count() == 0
    assert CT.read_records(spark, pq, where={"individualcount": 5}).count() == 1
