"""Edit matching against dynamic programming."""

import random

import pytest

from taxalake.llm import decontaminate as D


def distance(pattern, text):
    """Least edit distance between pattern and any part of text (Sellers)."""
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before), before.index(min(before))


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choices("abc", k=rng.randint(a, b))) for a, b in ((1, 90), (0, 120)))
        assert D.Pattern(p).best(t) == distance(p, t)


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at : at + rng.randint(0, 1)] = rng.choices("abcdefghij ", k=rng.randint(0, 1))
    return "".join(chars)


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.15])
def test_pigeonhole_search_misses_nothing(rate):
    rng = random.Random(3)
    found = 0
    for _ in range(120):
        item = D.normal("".join(rng.choices("abcdefghij ", k=rng.randint(30, 90))))
        text = D.normal(" ".join(["".join(rng.choices("abcdefghij ", k=60)), edited(rng, item, rng.randint(0, 12)), "xyz " * 9]))
        if len(item) < D.LEAST_CHARS:
            continue
        got = D.Block([(1, item)], rate).matches(text)
        least, _ = distance(item, text)
        assert bool(got) == (least <= int(rate * len(item)))
        if got:
            found += 1
            _, d, a, b = got[0]
            assert d == least and distance(item, text[a:b])[0] == least
    assert found > 5


ITEM = "Thieding. Onhe in haedea it ha with orbleat, the stea heerthly ranon."


def test_find_and_clean(spark):
    rng = random.Random(4)
    docs = [
        (1, "before it " + ITEM + " after it"), (2, "SHOUTED: " + ITEM.upper().replace(" ", "!! ")), (3, "nothing of that kind"),
        (4, edited(rng, ITEM, 4)), (5, None), (6, ""), (None, ITEM), (1, "before it " + ITEM + " after it"),
        (7, "word " * 60_000 + ITEM), (8, "*** " * 50),
    ]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, found string, distance int")
    items = spark.createDataFrame([(10, ITEM), (11, ITEM), (12, None), (13, "the"), (14, ""), (15, "an item that is found nowhere at all, ever")], "item_id long, text string")
    rows = D.find(frame, items, block_bytes=60).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in rows) == sorted((i, k) for i in ["1", "1", "2", "4", "7", "None"] for k in (10, 11))
    for r in rows:
        if r.doc_id == 1:
            assert docs[0][1][r.start : r.end] == ITEM[:-1] and r.distance == 0
    kept = D.clean(frame, items, block_bytes=60)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 8]
    assert D.find(frame.limit(0), items).count() == 0 and D.find(frame, items.limit(0)).count() == 0
    assert D.clean(frame, items.limit(0)).count() == len(docs)


def test_planted_items_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = {(r.doc_id, r.item_id): r.distance for r in D.find(docs, items).collect()}
    normal = {r.doc_id: D.normal(r.text) for r in docs.collect()}
    for item in items.collect():
        for i, text in normal.items():
            if D.normal(item.text) in text:
                assert rows.pop((i, item.item_id)) == 0
    for (i, item), d in rows.items():
        text = next(r.text for r in items.collect() if r.item_id == item)
        assert distance(D.normal(text), normal[i])[0] == d
