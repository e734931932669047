"""The Merkle manifest against trees built in plain Python."""

import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taxalake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, extra int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(hashes, arity=2):
    """The root, and what stands before and after each leaf's way, level by level."""
    ways = [[] for _ in hashes]
    level = [(h, [i]) for i, h in enumerate(hashes)]
    while len(level) > 1:
        above = []
        for a in range(0, len(level), arity):
            run = level[a : a + arity]
            for j, (_, own) in enumerate(run):
                for o in own:
                    ways[o].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            above.append((sha(*(h for h, _ in run)), [o for _, own in run for o in own]))
        level = above
    return level[0][0], ways


def leaf(row, add=0):
    n = None if row[3] is None else row[3] + add
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], n, row[4])))


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    root, up = tree([t[0] for t in trees])
    out = []
    for g, (subroot, ways), further in zip(groups, trees, up):
        for r, way in zip(g, ways):
            now = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for b, a in [*way, *further]:
                now = sha(b, now, a)
            out.append((r[0], leaf(r), subroot, root, sha(*(b + a for b, a in [*way, *further])), now, now == root))
    return sorted(out, key=str)


def found(spark, rows):
    got = merkle.prove(spark.createDataFrame(rows, SCHEMA))
    return sorted(map(tuple, got.collect()), key=str)


def test_all_rows_agree_with_plain_trees(spark):
    langs = ["en"] * 12 + ["de", "fr", None, "", "Z"]
    rows = [(i * 3 - 50, f"s{i % 4}" if i % 5 else None, langs[i % len(langs)], i if i % 11 else None, f"text ä {i % 37}" * (i % 4), i) for i in range(600)]
    rows += [(7, "s", "one", 1, "lone leaf", 0), (None, None, None, None, None, None), (4, "s", "en", 3, None, 1), (4, "s", "en", 3, None, 1), (4, "t", "en", 4, "", 1)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", 1, "x" * 100_000, 0) for i in range(n)]
    assert found(spark, rows) == (brute(rows) if n else [])


@pytest.mark.parametrize(("arity", "levels", "spread"), [(2, 1, 1), (2, 3, 2), (3, 2, 1), (4, 8, 8)])
def test_blocks_and_copies_of_ancestors(spark, arity, levels, spread):
    sizes = [1, 2, 3, 37, 130]
    hashes = {t: [sha(f"{t}-{i}") for i in range(n)] for t, n in enumerate(sizes)}
    rows = [(t, i, h, n) for t, n in enumerate(sizes) for i, h in enumerate(hashes[t])]
    leaves = spark.createDataFrame(rows, "t long, i long, h string, n long").withColumn("depth", merkle.depth_of(F.col("n"), arity))
    segments, roots, deepest = merkle.forest(leaves, arity, levels)
    way = merkle.jump(segments.withColumn("top", F.lit(None).cast("string")), deepest, arity, spread)
    got = {(r["t"], r["i"]): r["segment"] for r in way.collect()}
    root = {r["t"]: r["h"] for r in roots.collect()}
    for t, own in hashes.items():
        r, ways = tree(own, arity)
        assert root[t] == r
        assert [got[t, i] for i in range(len(own))] == ["".join(f"{b}.{a}/" for b, a in w) for w in ways]
    leaves = leaves.join(way, ["t", "i"]).select("t", merkle.fold(F.col("h"), F.col("segment")).alias("folded"))
    assert all(r["folded"] == root[r["t"]] for r in leaves.collect())


@given(st.integers(1, 10**6), st.integers(2, 5))
def test_depth(n, arity):
    d = 0
    while arity**d < n:
        d += 1
    powers = [arity**k for k in range(30)]
    assert sum(p < n for p in powers) == d


def test_manifest_keeps_other_columns(spark):
    rows = [("b", 2, sha("x"), 5.0), ("a", 1, sha("y"), 6.0), ("a", 1, sha("y"), 6.0)]
    out, root = merkle.manifest(spark.createDataFrame(rows, "g string, k int, leaf string, other double"), "g", ("k",))
    assert {"g", "k", "leaf", "other", "subroot", "root", "segment"} == set(out.columns)
    assert root == sha(sha(sha("y"), sha("y")), sha("x"))
    assert sorted(r["other"] for r in out.collect()) == [5.0, 6.0, 6.0]
