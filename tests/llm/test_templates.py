"""Line dedup on fixtures with a known answer, and exact lines against brute force."""

import random

import numpy as np

from taxalake.llm import templates
from taxalake.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, n_lines int, part string"


def run(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], COLUMNS)
    return templates.dedup(frame, **options)


def test_variable_fields_and_words(spark):
    docs = [
        (1, "Page 1 of 12 printed on 2020-01-01\nunique opening text of the first document"),
        (2, "another body that nobody else has at all\nPage 2 of 12 printed on 2021-05-09"),
        (3, "Page 77 of 90 printed on 1999-12-31\r\nPage 78 of 90 printed on 1999-12-31\nthe third body is its own"),
        (4, "Posted by the user anna on our board for all members\nfourth"),
        (5, "Posted by the user bert on our board for all members\nfifth body"),
        (6, "Posted by the user carl on our board for all members"),
        (7, "Posted by the user carl in your garden with some friends"),
        (8, "twice only here\nsome line"), (9, "twice only here\nsome other line"),
    ]
    got = {r.doc_id: r for r in run(spark, docs).collect()}
    assert got[1].text == docs[0][1] and got[4].text == docs[3][1]
    assert got[2].text == "another body that nobody else has at all"
    assert got[3].text == "the third body is its own" and got[3]["_n_lines"] == 3 and got[3].n_dropped == 2
    assert got[5].text == "fifth body" and got[6].text == ""
    assert got[7].text == docs[6][1] and got[8].text == docs[7][1] and got[9].text == docs[8][1]


def test_recurring_passages_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in "aeiou"]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    passages = [sentence(60) for _ in range(5)] + [sentence(6)]
    docs = []
    for i in range(60):
        lines = [sentence(rng.randint(12, 30)) for _ in range(rng.randint(1, 6))]
        for p in passages:
            if rng.random() < 0.15:
                lines.insert(rng.randint(0, len(lines)), p)
        docs.append((i, "\n".join(lines)))
    docs += [(100 + i, docs[0][1]) for i in range(4)]
    where = {}
    for i, t in docs:
        for line in set(t.split("\n")):
            where.setdefault(line, []).append(i)
    expected = {i: "\n".join(x for x in t.split("\n") if len(where[x]) < 3 or min(where[x]) == i) for i, t in docs}
    assert {r.doc_id: r.text for r in run(spark, docs).collect()} == expected
    small = {r.doc_id: r.text for r in run(spark, docs, portion=2).collect()}
    assert small == expected


def test_portions_of_a_leaf_merge(spark):
    docs = [(i, f"the very same leading words and tail x{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghij'[i // 26]} end of it") for i in range(200)]
    for portion in (50_000, 5):
        rows = run(spark, docs, portion=portion).collect()
        assert {r.doc_id for r in rows if r.n_dropped == 0} == {0}


def test_templates_do_not_widen(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[(i // 26**k) % 26] for k in range(3))
    docs = []
    for i in range(150):  # lines of a document's own, some alike in pairs, so that templates could chain
        lines = [f"see also here {word(i)} {word(i // 2 + 7000)}", f"see also here {word(i // 2 + 3000)} {word(i + 12000)}"]
        lines += [" ".join(["see also here", *(word(1000 * k + i) for k in range(n - 3))]) for n in (5, 6, 7)]
        lines += [f"see also here {word(i + 5000)} 7" if i % 2 else f"see also here 8 {word(i + 5000)}"]
        docs.append((i, "\n".join(lines)))
    for portion in (50_000, 20):
        assert {r.doc_id: r.text for r in run(spark, docs, portion=portion).collect()} == dict(docs)


def test_pieces_find_what_all_comparisons_find(monkeypatch):
    rng = np.random.default_rng(5)
    for size in (4, 5, 7, 10, 23):
        lines = rng.integers(0, 4, (400, size)).astype(np.uint32)
        lines[:, :3] = (9, 9, 0)
        lines[:, 3 + size // 8 :] = lines[:1, 3 + size // 8 :]
        lines[rng.integers(0, 400, 300), rng.integers(min(3, size - 1), size, 300)] = rng.integers(0, 50, 300)
        got = []
        for few in (0, 10**9):
            monkeypatch.setattr(templates, "FEW", few)
            leaf = templates.Leaf(size, 0.8)
            got.append([leaf.place(i, x) for i, x in enumerate(lines)])
        assert got[0] == got[1]


def test_passages_of_two_documents(spark, tmp_path):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    unspaced, rows = "\u6f22\u5b57" * 150, [passage + f" no {i}" for i in range(4)]
    docs = [(1, f"own\n{passage}"), (2, f"{passage}\nother own"), (3, f"{unspaced}\nthird"), (4, unspaced + "1"), (5, unspaced), (6, "twice only here"), (7, "twice only here"),
            (8, rows[0]), (9, rows[1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in QUERIES["op7_lines"](spark, str(tmp_path)).collect()}
    assert got == dict(docs) | {2: "other own", 5: ""}


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "a b"), (5, "a b"), (6, "a b"), (None, "one two three"), (None, "one two three"),
            (7, "one two three"), (8, "one two three"), (9, "one two three\n" * 20_000), (9, "z")]
    got = run(spark, docs)
    assert got.columns == ["doc_id", "text", "n_lines", "part", "_n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == ["\n\n"] and by[4] == by[5] == by[6] == ["a b"]
    assert by[7] == ["one two three"] and by[8] == [""] and by[None] == ["", ""] and sorted(by[9]) == ["", "z"]
    assert run(spark, docs).limit(0).count() == 0
    assert templates.dedup(spark.createDataFrame([], COLUMNS)).count() == 0
