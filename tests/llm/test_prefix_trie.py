"""The prefix trie against a trie in plain Python."""

import hashlib
import math
import random
import zlib

import pytest

from taxalake.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, path int"


def rebuilt(rows):
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    by = {c: [(t[2], t[4]) for t in sorted(own)] for c, own in by.items()}
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(by.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    return out


def brute(paths):
    nodes, kids = {}, {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in own) or 1
        saved[p] = sum(saved[k] for k in own) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(paths[c]) == len(p))
        up = min(nodes[p[:-1]]) if p else None
        out.append((min(nodes[p]), len(p), up, len(nodes[p]), len(own), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, segment):
    return sorted(map(tuple, T.trie(spark.createDataFrame(rows, SCHEMA), segment).collect()), key=str)


def dialogues(seed, n=60, most=9):
    rng, rows = random.Random(seed), []
    for c in range(-8, n):
        for turn in range(rng.randint(1, most)):
            # few texts, so that many prefixes are shared
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["yes", "nö", "", None]), 0))
    return rows


@pytest.mark.parametrize("segment", [1, 2, 3, 256])
def test_all_nodes(spark, segment):
    rows = dialogues(segment)
    assert found(spark, rows, segment) == brute(rebuilt(rows))


def test_copies_long_dialogues_and_odd_rows(spark):
    rows = [(c, i, "user", f"turn {i}", 0) for c in (5, 6, 7, 105) for i in range(40)]  # copies
    rows += [(c, i, "user", f"turn {i}" if i < 25 else f"{c} {i}", 0) for c in (200, 201) for i in range(60)]
    rows += [(None, 1, "user", "nobody's", 0), (300, None, "user", "first", 0), (300, 0, "user", "second", 0), (300, 0, "user", "second", 0)]
    rows += [(c, 0, "a", "only turn", 0) for c in (1001, 1002, 1003, 1004)]  # no base: some lose their turn
    want = brute(rebuilt(rows))
    assert found(spark, rows, 4) == want
    assert found(spark, rows, 256) == want


def test_hot_group_of_copies_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_TURNS", 20)
    monkeypatch.setattr(T, "CHUNK", 3)
    rows = [(c * 5, i, "user", f"same {i}", 0) for c in range(60) for i in range(3)] + dialogues(9, 20)
    rows = [(c + 10_000 if k >= 180 else c, *r, x) for k, (c, *r, x) in enumerate(rows)]
    assert found(spark, rows, 2) == brute(rebuilt(rows))


def test_empty_table(spark):
    assert found(spark, [], 256) == []
    assert found(spark, [(None, 1, "a", "b", 0)], 256) == []
