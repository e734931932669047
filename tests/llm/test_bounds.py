"""Loops that must finish or fail, samples that must not miss anyone, workers without the package."""

import os
import pickle
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest
import zstandard
from pyspark import cloudpickle
from pyspark.sql import functions as F

from taxalake.llm import decontaminate, graph, jaccard, langid, mixing, quality, templates, token_files, toxicity, words


def test_unfinished_components_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.components(path, rounds=1)
    assert {r["component"] for r in graph.components(path).collect()} == {0}


def test_unsolved_tilts_are_an_error(spark):
    counts = spark.createDataFrame([(0, s, 50) for s in (1, 10, 300)], "s long, size long, n long")
    aims = spark.createDataFrame([(0, 15550, 9000.0)], "s long, source_size long, target double")
    with pytest.raises(RuntimeError):
        mixing.tilts(counts, aims, steps=1)
    assert mixing.tilts(counts, aims).first()["tilt"] is not None


def test_a_language_of_many_copies_is_learned(spark):
    few = [(f"kopien sind texte wie andere auch {i} " * 3, "de") for i in range(3)] * 500
    many = [(f"every other text is here only once {i} " * 3, "en") for i in range(1500)]
    model = langid.fit(spark.createDataFrame(few + many, "text string, lang string"), docs_per_lang=20)
    assert set(model) == {"de", "en"}
    assert all(f"kopien sind texte wie andere auch".encode() in model["de"] for _ in range(1)) and model["de"].count(b"kopien") == 9


def test_languages_agree_with_plain_zstandard(spark):
    texts = {"de": "der schnelle braune fuchs springt über den faulen hund ", "en": "the quick brown fox jumps over the lazy dog ", "fr": "le renard brun saute par dessus le chien paresseux "}
    rows = [(i, texts[k] * (1 + i % 3) + f"{k} word{i}", k) for i, k in enumerate(list(texts) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}

    def size(dictionary, raw):
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(5, min_match=langid.MATCH, write_content_size=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress(raw))

    names = list(model)
    for i, text, _ in rows:
        assert got[i] == min(names, key=lambda k: (size(model[k], langid.normal(text)), names.index(k)))


def test_quality_sample_is_a_share(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    assert "GlobalLimit" not in str(quality.fit.__code__.co_names)
    trees = quality.fit(docs, labels.union(labels), max_rows=100)  # repeated rows count once
    assert quality.score_quality(docs, trees).count() == 400


def test_many_blocks_of_items_clean_as_one(spark):
    items = [(i, f"question number {i} asks about the {'very ' * (i % 5)}long history of thing {i * 7919} and its many uses") for i in range(30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"intro {i} {items[i % 30][1]} outro" if i % 3 == 0 else f"clean words of document {i}" if i % 5 else None, i) for i in range(120)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, extra int")
    one = sorted(map(str, decontaminate.clean(docs, benchmark).collect()))
    blocks = decontaminate.clean(docs, benchmark, block_bytes=400)
    assert sorted(map(str, blocks.collect())) == one and len(one) == 80 + 6
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_worker_functions_need_no_package(tmp_path):
    found = {
        "words": (words.word_hashes, ([b"Some words here", b""],)),
        "encoder": (token_files._byte_letters, ()),
        "part": (token_files.build_part, None),
        "grams": (jaccard.grams if hasattr(jaccard, "grams") else words.grams, None),
        "templates": (templates.place if hasattr(templates, "place") else words.mix, None),
        "pairs": (toxicity._pairs, ([b"one two", b"three"],)),
    }
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(found))
    code = "import pickle, sys\nfound = pickle.load(open(sys.argv[1], 'rb'))\nfor f, args in found.values():\n    args is None or f(*args)\nassert not any(m.split('.')[0] == 'taxalake' for m in sys.modules), 'imported'\nprint('fine')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path / "f.pkl")], capture_output=True, text=True, cwd=tmp_path, env=env)
    assert out.stdout.strip() == "fine", out.stderr
    assert pickle.loads(cloudpickle.dumps(words.mix)) is not None


def test_entries_reach_the_driver_as_arrow_in_pieces(spark):
    n, arrow = 200_000, "spark.sql.execution.arrow.pyspark.enabled"
    texts = ["alpha beta gamma", "beta beta", "", None, "delta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    key, before, word, _ = toxicity._pairs([(t or "").encode() for t in texts])
    known = np.unique(np.concatenate([key, toxicity._key(toxicity.CONTEXT, before), toxicity._key(toxicity.WORD, word)]).view(np.int64))
    found = spark.createDataFrame([(int(k), i + 1, -i) for i, k in enumerate(known)], "key long, total int, strong int")
    entries = spark.range(n).select(F.xxhash64("id").alias("key"), F.lit(7).alias("total"), F.lit(9).alias("strong")).union(found).repartition(8).localCheckpoint()
    given, seen = spark.conf.get(arrow), {}
    spark.conf.set(arrow, "false")  # the default: the session's setting must not matter
    try:
        for passes in (1, 3):
            model = toxicity.Model(entries, passes, 0.0, np.zeros(4))
            model.pieces = 1 if passes == 1 else 4
            tracemalloc.start()
            sums = model.sums(rows)
            assert tracemalloc.get_traced_memory()[1] < 120 * n
            tracemalloc.stop()
            seen[passes] = sorted(map(str, sums.collect()))
    finally:
        tracemalloc.stop()
        spark.conf.set(arrow, given)
    assert seen[1] == seen[3] and len(seen[1]) == len(texts)
    assert {r.id: r.total * toxicity.UNIT for r in sums.collect()}[4] == sum(int(np.searchsorted(known, h.view(np.int64)[-1])) + 1 for h in (key, toxicity._key(toxicity.CONTEXT, before), toxicity._key(toxicity.WORD, word)))
