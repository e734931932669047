import random

import numpy as np

from taxalake.llm import words
from taxalake.llm.graph import components


def test_word_hashes_follow_the_words():
    texts = [b"The  cat sat\ton", b"", b"the CAT sat on the mat ", "É x".encode(), b"x" * (3 * words.BLOCK) + b" the cat"]
    h, at = words.word_hashes(texts)
    expected = [w.lower() for t in texts for w in t.split()]
    assert list(np.diff(at)) == [len(t.split()) for t in texts]
    by_word = {}
    for w, x in zip(expected, h.tolist()):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_blocks_cut_between_words_only():
    rng = random.Random(1)
    text = b" ".join(bytes(rng.choices(range(97, 123), k=rng.randint(1, 9))) for _ in range(200_000))
    whole, _ = words.word_hashes([text])
    pieces = text.split()
    one, _ = words.word_hashes(pieces)
    assert len(text) > words.BLOCK and np.array_equal(whole, one)


def test_no_texts_and_grams():
    h, at = words.word_hashes([])
    assert len(h) == 0 and list(at) == [0]
    h, _ = words.word_hashes([b"a b c d e"])
    assert len(words.grams(h, 4)) == 2 and len(words.grams(h[:2], 4)) == 1 and len(words.grams(h[:0], 4)) == 0
    assert words.grams(h, 2)[0] != words.grams(h[::-1].copy(), 2)[-1]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    edges += [(100, 100 + i) for i in range(1, 80)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {n for e in edges if e[0] != e[1] for n in e}
    assert {r.node: r.component for r in rows} == {n: find(n) for n in linked}
    assert len(rows) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
