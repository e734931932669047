"""The splitting reader of quoted dumps against Spark's whole-file reader."""

import random

import pytest
from pyspark.sql import functions as F

from taxalake.sources import quoted
from taxalake.sources.delimited import CORRUPT, read_quoted_table, string_schema
from taxalake.sources.quoted import read_records

COLUMNS = ["A", "B", "C"]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def whole_files(spark, path):
    r = spark.read.schema(string_schema(COLUMNS, corrupt=True)).option("header", True).option("sep", "\t").option("quote", '"')
    r = r.option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return r.csv(path)


def field(rng):
    kind = rng.random()
    text = "".join(rng.choice(["a", "b", "é", " ", "x y"]) for _ in range(rng.randint(0, 6)))
    if kind < 0.3:
        return '"' + "".join(rng.choice(["a", '""', "\n", "\t", " ", '"",""']) for _ in range(rng.randint(0, 9))) + '"'
    return text + 'in"ch' if text and kind < 0.4 else text


def dump(path, rng, end, rows=250, tail=""):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("\ufeffA\tB\tC" + end)
        for _ in range(rows):
            f.write("\t".join(field(rng) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))) + end)
        f.write(tail)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_whole_file_reader(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    for i, (end, tail) in enumerate((("\n", ""), ("\r\n", ""), ("\n", '"open\tto the\nend'))):
        dump(tmp_path / f"{i}.txt", rng, end, tail=tail)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 20
    got = read_quoted_table(spark, str(tmp_path), COLUMNS)
    assert sorted(map(str, got.drop("_file", "_row").collect())) == sorted(map(str, whole_files(spark, str(tmp_path)).collect()))


def test_records_are_numbered_in_the_order_of_the_file(spark, tmp_path, small_splits):
    (tmp_path / "d.txt").write_text("A\tB\tC\n" + "".join(f'{i}\t"two\nlines {"x" * (i % 90)}"\tz\n' for i in range(200)))
    got = read_quoted_table(spark, str(tmp_path), COLUMNS).orderBy("_row").collect()
    assert [int(r["A"]) for r in got] == list(range(200))
    assert [r["_row"] for r in got] == list(range(2, 202))
    assert all(r["B"].startswith("two\nlines") for r in got)


def test_a_quote_that_spans_many_splits(spark, tmp_path, small_splits):
    body = "\n".join(f"line {i}" for i in range(300))
    (tmp_path / "d.txt").write_text(f'A\tB\tC\n1\t"{body}"\t3\n4\t5\t6\n')
    got = sorted((r["A"], r["B"], r["C"]) for r in read_quoted_table(spark, str(tmp_path), COLUMNS).collect())
    assert got == [("1", body, "3"), ("4", "5", "6")]


def test_blank_lines_empty_files_and_no_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A\tB\tC\n\n1\t2\t3\n\n")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("A\tB\tC\n")
    got = read_quoted_table(spark, str(tmp_path), COLUMNS)
    assert [(r["A"], r["B"], r["C"]) for r in got.collect()] == [("1", "2", "3")]
    assert read_records(spark, str(tmp_path)).count() == 5


def test_long_lines_with_many_quotes(spark, tmp_path):
    field = '"' + 'a""b' * 50_000 + '"'
    (tmp_path / "a.txt").write_text(f"A\tB\tC\n{field}\t{field}\t" + "\t".join(["x"] * 20_000) + "\n1\t2\t3\n")
    got = read_quoted_table(spark, str(tmp_path), COLUMNS)
    assert sorted(r["n"] for r in got.select(F.length("A").alias("n")).collect()) == [1, 150_000]


@pytest.mark.parametrize("bits", [0, 2])
def test_chunks_of_few_lines_give_the_same_records(spark, tmp_path, monkeypatch, bits):
    rng = random.Random(bits)
    dump(tmp_path / "a.txt", rng, "\n", rows=120, tail='"open\tto the\nend')
    dump(tmp_path / "b.txt", rng, "\r\n", rows=120)
    body = "\n".join(f"line {i}" for i in range(60))
    (tmp_path / "c.txt").write_text(f'A\tB\tC\n1\t"{body}"\t3\n4\t5\t6\n')
    before = read_quoted_table(spark, str(tmp_path), COLUMNS).collect()
    monkeypatch.setattr(quoted, "CHUNK_BITS", bits)
    monkeypatch.setattr(quoted, "TASK_BYTES", 500)
    got = read_quoted_table(spark, str(tmp_path), COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, before))
    assert sorted(map(str, got.drop("_file", "_row").collect())) == sorted(map(str, whole_files(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("field", ["x y", '"two\nlines"'])
def test_a_large_split_is_dealt_over_tasks(spark, tmp_path, monkeypatch, field):
    monkeypatch.setattr(quoted, "CHUNK_BITS", 8, raising=False)
    monkeypatch.setattr(quoted, "TASK_BYTES", 32_000, raising=False)
    n = 20_000
    (tmp_path / "d.txt").write_text("A\tB\tC\n" + "".join(f"{i}\t{field}\tz\n" for i in range(n)))
    records = read_records(spark, str(tmp_path))
    sizes = [r["count"] for r in records.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n + 1 and max(sizes) < n / 3
    assert records.agg(F.count_distinct("_row")).first()[0] == n + 1
