"""The join against brute force over all pairs."""

import random
import re

import pytest

from taxalake.llm import jaccard

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(docs, n, percent):
    sets = [(i, shingles(t, n)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y in range(x):
            j, b = sets[y]
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    out = []
    for x, (i, a) in enumerate(sets):
        group = [j for y, (j, _) in enumerate(sets) if find(y) == find(x)]
        out.append((i, len(a), None if i is None else min(group)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    boilerplate = " ".join(rng.choices(vocabulary, k=60))
    docs = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 8, 20, 60, 150]))
        if rng.random() < 0.4:
            base += boilerplate.split()
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
            docs.append("\t ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return list(enumerate(docs))


@pytest.mark.parametrize("seed, n, percent", [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_join_matches_brute_force(spark, seed, n, percent):
    docs = corpus(seed)
    found = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), n=n, percent=percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found], key=str) == brute(docs, n, percent)


def test_edges(spark):
    long_ = " ".join(f"x{i}" for i in range(40_000))
    docs = [(7, None), (8, ""), (9, " \n\t"), (3, "a b"), (2, "A  b"), (2, "A  b"), (1, "a c"), (None, "a b"), (None, None),
            (20, long_), (21, long_ + " y"), (5, "q r s t u"), (5, "other text of the same id here"), (4, "q r s t u")]
    frame = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], "doc_id long, text string, node string, size long, component int")
    found = jaccard.join(frame)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()], key=str) == brute(docs, 4, 85)
    kept = jaccard.keep_one(frame, n=5, percent=80)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id != 5]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 7, 8, 9, 20] and ids.count(None) == 2
    empty = frame.limit(0)
    assert jaccard.join(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_a_group_of_near_copies_makes_few_pairs(spark):
    """No step sees all pairs of a large group."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"u{i}_{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.join(frame).collect()}
    assert found == {i: c for i, _, c in brute(docs, 4, 85)}
    texts = jaccard._own(
        frame.join(jaccard.sizes(frame.withColumnRenamed("doc_id", "id"), 4).withColumnRenamed("id", "doc_id"), "doc_id").select("node", "size", "text"), 4
    ).dropDuplicates(["node"])
    lists = jaccard._lists(texts, 4, 85)
    from pyspark.sql import functions as F

    heads = lists.groupBy("gram").agg(F.max(F.struct("rest", "node", "size")).alias("h")).select("gram", "h.*")
    assert jaccard._met(heads, lists, 85).count() < 10 * len(docs)
