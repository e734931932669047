"""Targets, tilts and copies against plain Python."""

import math
import random

from taxalake.llm import mixing


def level_targets(sizes):
    """Targets by sharing the excess again until none is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, list(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def corpus(seed, sources, docs):
    rng = random.Random(seed)
    rows = []
    for i in range(docs):
        s = rng.choice(sources)
        n = int(rng.lognormvariate(4, 1.2)) if rng.random() < 0.9 else rng.choice([0, 1, 7])
        rows.append((i, " ".join(["w"] * n), s))
    return rows


def summed(rows):
    out = {}
    for r in rows:
        out[r["source"]] = out.get(r["source"], 0) + r["taken"]
    return out


def test_targets_and_copies(spark):
    docs = corpus(1, ["b", "a", "é", "B", None, "c", "tiny"], 900) + [(2000, "x y", "tiny2")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    size = {i: len(t.split()) for i, t, _ in docs}
    of = {i: s for i, _, s in docs}
    sizes = {}
    for i, n in size.items():
        sizes[of[i]] = sizes.get(of[i], 0) + n
    expected = level_targets(sizes)
    got = [r.asDict() | {"source": of[r.doc_id]} for r in mixing.mix(frame).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    biggest = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], expected[r["source"]], rel_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        biggest[r["source"]] = max(biggest.get(r["source"], 0), r["size"])
    for s, words in summed(got).items():
        assert abs(words - expected[s]) <= max(2, 0.01 * expected[s], 0.02 * biggest[s])
    again = {r.doc_id: r.taken for r in mixing.mix(frame.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    # the rates meet the targets and are tilted by size: log-odds in proportion to the size
    for s in set(of.values()):
        own = [r for r in got if r["source"] == s and r["size"]]
        assert math.isclose(sum(r["rate"] * r["size"] for r in own), expected[s], rel_tol=1e-5)
        free = [r for r in own if 0.02 < r["rate"] < 1.98 and abs(r["rate"] - 1) > 1e-6]
        slopes = [math.log(r["rate"] / (2 - r["rate"])) / r["size"] for r in free]
        assert not slopes or max(slopes) - min(slopes) <= 1e-6 * max(map(abs, slopes)) + 1e-9


def test_a_source_of_equal_documents(spark):
    docs = [(i, "one two three four", "hot") for i in range(3000)] + [(i, "a b", "cold") for i in range(3000, 3100)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    words = sum(r.taken for r in rows if r.doc_id < 3000)
    assert abs(words - next(r.target for r in rows if r.doc_id == 0)) <= 4


def test_edges(spark):
    docs = [(1, None, "a"), (2, "", None), (None, "x y z", None), (3, "p q", "a"), (3, "p q", "a"), (4, "w " * 50_000, "b")]
    frame = spark.createDataFrame([(i, t, s, 1, 1) for i, t, s in docs], "doc_id long, text string, source string, copies int, size int")
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(docs) and {r.taken for r in rows if r.size == 0} == {0}
    kept = mixing.take(frame)
    assert kept.columns == [*frame.columns, "_copies"]
    assert sum(r._copies * len((r.text or "").split()) for r in kept.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.take(frame.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(frame.where("text is null or text = ''")).collect()} == {0}
    one = mixing.mix(frame.where("source = 'b'")).first()
    assert one.target == 75_000 and one.taken in (50_000, 100_000)
