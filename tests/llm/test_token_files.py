"""Token-ID files: exact round trips, the hash's slots, and what the index refuses."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxalake.llm import token_files as T
from taxalake.session import scratch_path

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
ENCODER = T.Encoder(PATH, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZß'sStdléİΣσſKDž.,!»«—-19²½́̇\x1c\x85 \t\n <|>中가가"), max_size=30), max_size=4))
def test_remembered_words_give_the_tokenizers_ids(texts):
    plain = [ENCODER.plain(x) + ENCODER.end for x in texts]
    assert ENCODER.encode(texts) == plain


def test_special_tokens_and_forgetting():
    small = T.Encoder(PATH, 1, memory=3)
    texts = ["a b c d <|endoftext|> e", "x<|endoftext|>'s", "", "   ", "don't DON'T it's", "a b c d"] * 3
    assert small.apart and small.encode(texts) == [small.plain(x) + small.end for x in texts]
    assert small.encode(texts) == small.encode(texts)


class Calls:
    """A tokenizer that counts how often it is asked."""

    def __init__(self, inner):
        self.inner, self.n = inner, 0

    def encode_batch_fast(self, *args, **options):
        self.n += 1
        return self.inner.encode_batch_fast(*args, **options)


def test_new_words_reach_the_model_together():
    encoder = T.Encoder(PATH, 1)
    encoder.model = calls = Calls(encoder.model)
    texts = [f"Éword{chr(97 + i % 26)}{'xyz'[i % 3] * (i % 40)}, it's nr.{i}\xa0end " * 3 for i in range(2000)]
    # a slice of an array, whose words end at ASCII white space only until they are looked up
    column = pa.array(["before", *texts, "after"]).slice(1, 2000)
    assert encoder.apart and encoder.encode(column) == [encoder.plain(x) + encoder.end for x in texts]
    assert calls.n == 1
    encoder.encode(column)
    assert calls.n == 1  # all remembered


def test_words_asked_for_lately_are_kept():
    kept, made = T._Kept(6), []

    def make(keys):
        made.extend(keys)
        return [k.encode() for k in keys]

    for i in range(9):
        assert kept.all(["often", f"once{i}", f"other{i}"], make, step=2) == [b"often", b"once%d" % i, b"other%d" % i]
        assert len(kept.new) + len(kept.old) <= 2 * 6
    assert made.count("often") == 1 and kept.all(["once0"], make) == [b"once0"] and made.count("once0") == 2


@given(st.lists(st.integers(0, 40), min_size=1, max_size=30))
def test_portions_are_all_texts_in_order(sizes):
    texts, old = pa.array(["x" * n for n in sizes]), T.TEXT_BYTES
    T.TEXT_BYTES = 16
    try:
        got = list(T._portions(texts))
    finally:
        T.TEXT_BYTES = old
    assert [x for p in got for x in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) and sum(map(len, p.to_pylist()[1:])) < 16 for p in got)


def expected(rows):
    out, at = [], 0
    key = {t: None for _, t in rows}
    ids = {t: list(np.frombuffer(b, "<u2")) for t, b in zip(key, ENCODER.encode([t or "" for t in key]))}
    for doc, text in rows:
        own = np.array(ids[text], "<u4")
        out.append((doc, at, len(own), zlib.crc32(own.tobytes())))
        at += len(own)
    return out


def read_all(spark, docs, **options):
    files = T.write(docs, scratch_path(spark, "tokens"), PATH, **options)
    got = files.read(T.keys_of(docs)).select("id", "copy", "start", "n", F.crc32("ids").alias("crc"))
    return files, got


def test_round_trip(spark):
    rows = [(i, f"Some words {i} " * (i % 50)) for i in range(300)] + [(1000, None), (1001, ""), (2000, "long ünïcode text " * 20_000)]
    docs = spark.createDataFrame([(t, d, 1) for d, t in reversed(rows)], "text string, doc_id long, copy int").repartition(5)
    files, got = read_all(spark, docs)
    assert sorted((r["id"], r["start"], r["n"], r["crc"]) for r in got.collect()) == expected(rows)
    assert files.documents == 303


def test_many_shards_give_the_same(spark, monkeypatch):
    rows = [(i, f"word{i} " * 40) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(T, "SHARD_BYTES", 2000)
    monkeypatch.setattr(T, "PART_KEYS", 4)
    files, got = read_all(spark, docs)
    assert files.shards.count() > 8 and files.bits >= 5
    assert sorted((r["id"], r["start"], r["n"], r["crc"]) for r in got.collect()) == expected(rows)


def test_null_and_equal_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "n"), (5, "a b"), (5, "a b"), (5, "c"), (None, None)], "doc_id long, text string")
    _, got = read_all(spark, docs)
    got = got.collect()
    assert sorted((r["id"] is not None, r["copy"]) for r in got) == [(False, 0), (False, 1), (True, 0), (True, 1), (True, 2)]
    at = 0
    for r in sorted(got, key=lambda r: (r["id"] is not None, r["copy"])):
        assert r["start"] == at
        at += r["n"]
    _, none = read_all(spark, docs.where("false"))
    assert none.collect() == []


def test_text_keys_and_strangers(spark):
    docs = spark.createDataFrame([(f"k{i}", "x " * i) for i in range(50)], "name string, body string")
    files = T.write(docs, scratch_path(spark, "tokens"), PATH, end=None, id_col="name", text="body")
    asked = spark.createDataFrame([("k3", 0), ("k3", 1), ("nobody", 0), (None, 0)], "name string, copy int")
    got = files.read(asked, id_col="name").collect()
    assert [(r["id"], r["n"]) for r in got] == [("k3", 3)]


@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=300))
@settings(max_examples=50, deadline=None)
def test_minimal_perfect_hash(keys):
    h = np.array(sorted(keys), dtype=np.uint64).reshape(-1, 2).T
    entries = np.stack([np.arange(h.shape[1]) + k for k in (0, 1000, 5000)], axis=1)
    part = T.build_part(h, entries)
    assert (T.find_in_part(part, h) == entries).all()
    assert len(part) < 40 * h.shape[1] + 200  # as many slots as keys


def test_equal_first_hashes_are_listed_or_settled():
    h = np.array([[1] * 40, range(40)], dtype=np.uint64)
    entries = np.stack([np.arange(40)] * 3, axis=1)
    old, T.LEVELS = T.LEVELS, 1
    try:
        part = T.build_part(h, entries)
    finally:
        T.LEVELS = old
    assert (T.find_in_part(part, h) == entries).all()
    assert T.find_in_part(part, np.array([[9, 8], [7, 6]], np.uint64)).shape == (2, 3)
