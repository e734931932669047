"""Each stage against a plain version on its own input, and the contract of the registered queries."""

import os
import re
import subprocess
import sys

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import distance
from test_jaccard import brute

import __spark_entry__ as E
from taxalake.llm import common, decontaminate, mixing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(line):
    return ["0" if any(c in "0123456789@" for c in w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line.lower())]


def alike(a, b):
    """Whether two lines' words are one template: 80 % of those that aren't fields in both, 40 % of all."""
    same = sum(x == y != "0" for x, y in zip(a, b))
    both = sum(x == y == "0" for x, y in zip(a, b))
    return len(a) == len(b) and same >= 0.8 * (len(a) - both) and same >= 0.4 * len(a)


def template_docs(line, where):
    """Of the lines that the given one is like: the most documents that hold a line like one of them."""
    near = [y for y in where if alike(words(line), words(y))]
    return max(len({i for z in where if alike(words(z), words(y)) for i in where[z]}) for y in near)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    docs = common.read(spark, SF, "documents")
    assert docs.columns == COLUMNS and len(corpus_pipeline.STAGES) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), name)
        seen[name] = docs
    assert [seen[n].columns for n in ("language", "lines", "near_duplicates", "benchmark")] == [COLUMNS] * 4
    raw, one, two, three, four = (texts(common.read(spark, SF, "documents")), *(texts(seen[n]) for n in ("language", "lines", "near_duplicates", "benchmark")))
    assert set(one) <= set(raw) and len(one) > 0.98 * len(raw) and all(raw[i] == t for i, t in one.items())

    assert set(two) == set(one)
    where = {}
    for i, t in one.items():
        for line in set(t.split("\n")):
            where.setdefault(line, []).append(i)
    for i, t in two.items():
        lines = t.split("\n") if t else []
        # no exact line of three tokens and more is left in three documents
        assert all(len(x.split()) < 3 or len(where[x]) < 3 or min(where[x]) == i for x in lines)
        # a line goes only with a template of three documents, or as a passage of two
        for x in set(one[i].split("\n")) - set(lines):
            passage = len(words(x)) >= 50 or len(x) > 250
            assert len(where[x]) >= (2 if passage else 3) or template_docs(x, where) >= 3, x
        # no passage is left in two documents
        assert all(len(words(x)) < 50 or len(where[x]) < 2 or min(where[x]) == i for x in lines)
    assert all(r.n_chars == len(r.text) for r in seen["lines"].collect())

    kept = {i for i, _, c in brute(sorted(two.items()), 5, 80) if i == c}
    assert set(three) == kept

    items = [decontaminate.normal(r.text) for r in common.read(spark, SF, "benchmark").collect()]
    for i, t in three.items():
        normal = decontaminate.normal(t)
        held = any(m in normal for m in items)
        assert not (held and i in four)
        if i not in four and not held:
            assert any(distance(m, normal)[0] <= int(decontaminate.RATE * len(m)) for m in items)

    mixed = {r.doc_id: r.copies for r in mixing.mix(seen["benchmark"]).collect()}
    assert {r.doc_id: r.copies for r in seen["mix"].collect()} == {i: c for i, c in mixed.items() if c}
    assert {r.doc_id: r.copies for r in corpus_pipeline.run(spark, SF).collect()} == {i: c for i, c in mixed.items() if c}


def test_stages_on_odd_tables(spark, tmp_path):
    common.read(spark, SF, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a text without an id but with words", "en", "a", 5), (3, "same words here again and again", "en", None, 1),
            (3, "same words here again and again", "en", None, 1), (4, "word " * 50_000, "en", "b", 2), (5, "1234", "de", "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit(1)).withColumn("found", F.lit("x"))
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns
            now = common.stored(out, name)
        assert now.count() == (0 if empty else 3)


def test_registered(spark):
    names = list(E.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and "op10_chat" in E.oracle_sql()


def test_the_rest_imports_without_this_part(tmp_path):
    code = (
        "import sys; sys.modules['taxalake.llm'] = None; import __spark_entry__ as E; "
        "q = E.queries(); assert len(q) >= 50 and 'pipeline' not in q and not any(x.startswith('op1_') for x in q)"
    )
    root = os.path.dirname(os.path.abspath(E.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
