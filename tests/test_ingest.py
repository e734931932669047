"""Typed ingest of library dumps: TSV reader, typing rules, error budget."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxalake.functions.casts import ITEM_COLUMNS, ITEM_RULES, SUBJECT_COLUMNS, SUBJECT_RULES
from taxalake.operators import validate as V
from taxalake.sources.delimited import CORRUPT, read_quoted_table

HEADER = "\t".join(ITEM_COLUMNS)


def item(itemid="1", titleid="2", thumb="3", barcode="bc1", localid="loc", created="2006-01-18 11:23"):
    return "\t".join([itemid, titleid, thumb, barcode, "m", "c", "v", "u", localid, "1900", "inst", "z", created])


def write_tsv(path, lines, bom=True):
    text = ("﻿" if bom else "") + HEADER + "\n" + "\n".join(lines) + "\n"
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def typed(spark, path):
    raw = read_quoted_table(spark, path, list(ITEM_COLUMNS)).withColumnRenamed("_row", "rn")
    return V.type_rows(raw, ITEM_RULES, keep=("rn", CORRUPT))


def test_reader_bom_quotes_and_short_rows(spark, tmp_path):
    lines = [
        item(),
        item(itemid="2", localid='"multi\nline"'),
        "3\t4",  # short row (an unescaped line break cut it)
        item(itemid="5"),
    ]
    raw = read_quoted_table(spark, write_tsv(tmp_path / "item.txt", lines), list(ITEM_COLUMNS))
    rows = raw.orderBy("_row").collect()
    assert [r.ItemID for r in rows] == ["1", "2", "3", "5"]  # BOM gone from the first name, one row per record
    assert rows[1].LocalID == "multi\nline"
    assert rows[2].BarCode is None and rows[2].TitleID == "4"
    assert rows[0].CreationDate == "2006-01-18 11:23"


def test_typing_rules(spark, tmp_path):
    lines = [
        item(),
        item(itemid="10", titleid=" "),  # blank int -> null, kept
        item(itemid="11", titleid=" 5 "),  # padded int -> 5
        item(itemid="12", titleid="zz"),  # bad int
        item(itemid="13", titleid="5.0"),  # bad int
        item(itemid="14", created="n/a"),  # bad date
        item(itemid="15", created="2006-01-18"),
        item(itemid="16", created=""),  # blank date -> null, kept
    ]
    t = typed(spark, write_tsv(tmp_path / "item.txt", lines))
    good, bad = V.split_valid(t)
    g = {r.itemid: r for r in good.collect()}
    assert set(g) == {1, 10, 11, 15, 16}
    assert g[1].creationdate == dt.date(2006, 1, 18) and g[1].titleid == 2
    assert g[10].titleid is None and g[11].titleid == 5
    assert g[15].creationdate == dt.date(2006, 1, 18) and g[16].creationdate is None
    reasons = {r.reason: r.n_rows for r in V.reject_report(t).collect()}
    assert reasons == {"titleid": 2, "creationdate": 1}
    assert good.columns[:4] == ["rn", CORRUPT, "itemid", "titleid"]


def test_required_columns(spark):
    rows = [(1, "7", "s", "2001-02-03"), (2, None, "s", "2001-02-03"), (3, "8", "s", None), (4, "9", "s", "bad")]
    raw = spark.createDataFrame(rows, "rn long, TitleID string, Subject string, CreationDate string")
    good, bad = V.split_valid(V.type_rows(raw, SUBJECT_RULES))
    assert [r.rn for r in good.collect()] == [1]
    assert good.columns == ["rn"] + [c.lower() for c in SUBJECT_COLUMNS]
    assert bad.count() == 3


@pytest.mark.parametrize("n_bad, kept", [(50, 100), (51, 51)])
def test_error_budget_edge(spark, n_bad, kept):
    # rows 1..100 are good with n_bad bad rows interleaved after each good row
    rows, rn = [], 0
    for i in range(100):
        rn += 1
        rows.append((rn, str(i)))
        if i < n_bad:
            rn += 1
            rows.append((rn, "bad"))
    raw = spark.createDataFrame(rows, "rn long, ItemID string")
    from taxalake.functions.casts import Rule

    t = V.type_rows(raw, [Rule("ItemID", "itemid", "int")])
    out = V.apply_error_budget(t, "rn", budget=50, on_exceed="truncate")
    assert V.apply_error_budget(t, "rn", budget=50).count() == 100  # the default loses no good row
    # with 51 bad rows, reading stops at bad row 51, which follows good row 51
    assert out.count() == kept
    if n_bad > 50:
        with pytest.raises(ValueError):
            V.apply_error_budget(t, "rn", budget=50, on_exceed="fail")


def test_row_slice(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "rn")
    out = [r.rn for r in V.row_slice(df, "rn", tail=300, head=5).collect()]
    assert out == [701, 702, 703, 704, 705]


def test_error_budget_over_many_files(spark, tmp_path):
    """Budget order follows (file, row): 30 bad rows in a.txt, 30 in b.txt ->
    the 51st bad row is in b.txt; a.txt's good rows all stay."""
    from taxalake.sources.delimited import row_order

    d = tmp_path / "dump"
    d.mkdir()
    for name, start in (("a.txt", 0), ("b.txt", 1000)):
        lines = []
        for i in range(60):
            lines.append(item(itemid=str(start + i)) if i % 2 == 0 else item(itemid="bad"))
        write_tsv(d / name, lines, bom=False)
    raw = read_quoted_table(spark, str(d), list(ITEM_COLUMNS))
    t = V.type_rows(raw.withColumn("rn", row_order(raw)), ITEM_RULES, keep=("rn",))
    kept = sorted(r.itemid for r in V.apply_error_budget(t, "rn", budget=50, on_exceed="truncate").collect())
    # a.txt: all 30 good rows; b.txt: good rows before its 21st bad row (line 41)
    assert kept == list(range(0, 60, 2)) + list(range(1000, 1041, 2))


@pytest.mark.parametrize(
    "text, date",
    [
        ("2016-05-03 12:00:00.123", "2016-05-03"), ("2016-05-03T00:00:00Z", "2016-05-03"), ("2016-05-03 10:11:12+02:00", "2016-05-03"),
        ("May 3 2016", "2016-05-03"), ("may 3, 2016 10:00", "2016-05-03"), ("3 September 2016", "2016-09-03"), ("03-Sep-2016", "2016-09-03"),
        ("5/3/2016 1:02:03 PM", "2016-05-03"), ("12/31/1999", "1999-12-31"), ("20160503", "2016-05-03"), ("2016/05/03 10:20", "2016-05-03"),
        ("2016-05-03T10:20", "2016-05-03"), ("2016-5-3", "2016-05-03"), ("13/31/1999", None), ("2016-02-30 10:00", None), ("n/a", None),
    ],
)
def test_date_shapes(spark, text, date):
    from taxalake.functions.casts import nullable_date

    value, ok = nullable_date(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(value.alias("v"), ok.alias("ok")).first()
    assert (str(r.v) if r.v else None) == date and r.ok == (date is not None)


def test_short_and_long_rows_are_rejected_with_a_reason(spark, tmp_path):
    p = tmp_path / "dump.txt"
    p.write_text("ItemID\tTitleID\n1\t2\n3\n4\t5\t6\nx\n")
    raw = read_quoted_table(spark, str(p), ["ItemID", "TitleID"])
    from taxalake.functions.casts import Rule
    from taxalake.sources.delimited import row_order

    t = V.type_rows(raw.withColumn("rn", row_order(raw)), [Rule("ItemID", "itemid", "int"), Rule("TitleID", "titleid", "int")], keep=("rn",))
    good, _ = V.split_valid(t)
    assert [(r.itemid, r.titleid) for r in good.collect()] == [(1, 2)]
    reasons = sorted(r.reason for r in V.bad_rows(t).collect())
    assert reasons == ["_corrupt", "_corrupt", "_corrupt,itemid"]


DATES = [  # text, month first, day first, day first and the missing filled with the first
    ("5/3/2016", "2016-05-03", "2016-03-05", "2016-03-05"), ("31/12/1999", "1999-12-31", "1999-12-31", "1999-12-31"),
    ("12/31/1999", "1999-12-31", "1999-12-31", "1999-12-31"), ("2016-05-03", "2016-05-03", "2016-05-03", "2016-05-03"),
    ("2016-13-05", None, None, None), ("Tue, 03 May 2016 10:11:12 GMT", "2016-05-03", "2016-05-03", "2016-05-03"),
    ("3rd of May, 2016", "2016-05-03", "2016-05-03", "2016-05-03"), ("Sept. 21st 2016", "2016-09-21", "2016-09-21", "2016-09-21"),
    ("2016 May 3", "2016-05-03", "2016-05-03", "2016-05-03"), ("5/3/68", "2068-05-03", "2068-03-05", "2068-03-05"),
    ("5/3/69", "1969-05-03", "1969-03-05", "1969-03-05"), ("99.1.2", "1999-01-02", "1999-01-02", "1999-01-02"),
    ("20160503T101112Z", "2016-05-03", "2016-05-03", "2016-05-03"), ("20161305", None, None, None),
    ("2016", None, None, "2016-01-01"), ("2016-05", None, None, "2016-05-01"), ("May 2016", None, None, "2016-05-01"), ("2016 may", None, None, "2016-05-01"),
    ("1/2/3", None, None, None), ("2016-05-2017", None, None, None), ("123/5/3", None, None, None), ("2016-05-03 25:00", None, None, None),
    ("May 3 2016 or so", None, None, None), ("around 2016", None, None, None), ("Mayday 3 2016", None, None, None), ("=2016 5 3", None, None, None),
    ("2016-02-29", "2016-02-29", "2016-02-29", "2016-02-29"), ("2015-02-29", None, None, None), ("0/1/2016", None, None, None), ("5", None, None, None),
    ("", None, None, None), ("  ", None, None, None), (None, None, None, None), ("9" * 100_000, None, None, None), ("1/" * 50_000, None, None, None),
]


def test_date_grammar(spark):
    from taxalake.functions.casts import read_date

    t = F.col("t")
    rows = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "i int, t string").select(
        "i", read_date(t), read_date(t, day_first=True), read_date(t, day_first=True, partial="first")
    )
    got = {r[0]: tuple(str(x) if x else None for x in r[1:]) for r in rows.collect()}
    assert [(str(d[0])[:30], *got[i]) for i, d in enumerate(DATES)] == [(str(d[0])[:30], *d[1:]) for d in DATES]
    with pytest.raises(ValueError):
        read_date(t, partial="today")


def test_patterns_instead_of_the_grammar(spark):
    from taxalake.functions.casts import nullable_date

    value, ok = nullable_date(F.col("t"), formats=("yyyy-M-d",))
    rows = spark.createDataFrame([("2016-5-3",), ("May 3 2016",), (" ",)], "t string").select(value, ok).collect()
    assert [(str(r[0]), r[1]) for r in rows] == [("2016-05-03", True), ("None", False), ("None", True)]
