"""Fingerprints, next documents and near fingerprints against plain Python."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from taxalake.llm import simhash


def fingerprint(text):
    votes, total = [0] * 64, 0
    for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        total += len(w)
        for i in range(64):
            votes[i] += len(w) * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def apart(a, b):
    return bin(a ^ b).count("1")


def check(rows, docs):
    """``docs``: (id, text) with distinct ids."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0)))
    marks = [fingerprint(t) for _, t in docs]
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(docs)
    for at, (i, t) in enumerate(docs):
        after, half, r = (at + 1) % len(docs), len(t) // 2, got[i]
        edited = t[: len(t) - half] + docs[after][1][:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == f"{marks[at]:016x}" and r.edited_fingerprint == f"{fingerprint(edited):016x}"
        assert abs(r.near_edited - (1 - apart(marks[at], fingerprint(edited)) / 64)) < 1e-12
        assert abs(r.near_next - (1 - apart(marks[at], marks[after]) / 64)) < 1e-12
        near = sum(apart(marks[at], m) <= 3 for m in marks) - 1
        assert r.n_near == (near if i is not None and i % 50 == 0 else None)


def test_small_tables(spark):
    docs = [(0, "one two three"), (50, None), (100, ""), (7, "é€😀 x" * 3), (None, "null id here"), (9, "one two three"), (-5, "a\tb\n" * 30_000)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, k int, h int")
    check(simhash.compare(frame).collect(), docs)
    one = [(3, "only one")]
    check(simhash.compare(spark.createDataFrame(one, "doc_id long, text string")).collect(), one)
    assert simhash.compare(frame.limit(0)).count() == 0


def test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(simhash.compare(frame).collect(), [tuple(r) for r in frame.collect()])


def test_equal_ids(spark):
    frame = spark.createDataFrame([(1, "first text"), (1, "first text"), (1, "an other"), (2, "second of them")], "doc_id long, text string")
    rows = simhash.compare(frame).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 1, 2]
    face = max(("first text", "an other"), key=lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + 2**63) % 2**64)
    two = next(r for r in rows if r.doc_id == 2)
    assert two.edited_sha256 == hashlib.sha256(("second of them"[:7] + face[:7]).encode()).hexdigest()


def test_near_finds_all_within_the_radius(spark):
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for p in list(points):
        for k in range(6):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            points.add(q)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in points]
    frame = spark.createDataFrame(signed, "fingerprint long")
    for radius, blocks in ((3, 5), (2, 4), (0, 1), (4, 6)):
        got = sorted((r["query"] % 2**64, r["point"] % 2**64) for r in simhash.near(frame, frame, radius, blocks).collect())
        assert got == sorted((p, q) for p in points for q in points if apart(p, q) <= radius)


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    plan = simhash.fingerprints(frame, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert frame.select(F.lit(1)).count() == 9
