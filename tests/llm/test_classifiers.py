"""Quality, toxicity and language: held-out accuracy, defined results for odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxalake.llm import langid, quality, toxicity
from taxalake.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("name, label, mod, rest, least_auc, least_right", [("op1_quality", "quality", 5, 0, 0.99, 0.98), ("op6_toxicity", "toxic", 4, 2, 0.93, 0.96)])
def test_held_out(spark, name, label, mod, rest, least_auc, least_right):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = QUERIES[name](spark, SF).toPandas()
    assert len(rows) == 10_000 and rows["score"].between(0, 1).all()
    assert (rows["held_out"] == rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % mod == rest)).all()
    assert (rows["predicted"] == (rows["score"] >= 0.3)).all()
    held = rows[rows["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least_auc
    assert (held["predicted"] == held[label]).mean() > least_right


def test_language_held_out(spark):
    rows = QUERIES["op9_language"](spark, SF).toPandas()
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = rows[rows["held_out"]].merge(langs, on="doc_id")
    assert len(rows) == 10_000 and rows["score"].between(0, 1).all() and set(rows["lang_pred"]) <= {"en", "de", "fr", "es", "und"}
    assert (held["lang_pred"] == held["lang"]).mean() > 0.985
    assert rows["rejected"].mean() < 0.01


ODD = [(1, None), (2, ""), (3, "12 34 !!"), (None, "plain words of a text"), (4, "plain words of a text"), (4, "plain words of a text"), (5, "word " * 100_000)]


def odd(spark):
    return spark.createDataFrame([(i, t, 0.5, "zz") for i, t in ODD], "doc_id long, text string, score double, lang string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LABELS = [(1, 0, 1), (4, 1, 0), (4, 1, 0), (5, 0, 1), (99, 1, 1), (None, 1, 0), (2, None, None), (3, 7, 7)]


@pytest.mark.parametrize("given", [[], LABELS, [(4, 1, 1)], [(4, 0, 0), (5, 0, 0)]])
def test_odd_rows_and_labels(spark, given):
    docs = odd(spark)
    for module, score in ((quality, quality.score_quality), (toxicity, toxicity.score_toxicity)):
        rows = score(docs, module.fit(docs, labels(spark, given))).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        same = [r.score for r in rows if r.doc_id in (4, None)]
        assert len(set(same)) == 1
        assert score(docs.limit(0), module.fit(docs.limit(0), labels(spark, given))).count() == 0


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality.grow(x, y, trees=30, depth=3)
    scores = model.scores(x)
    assert ((scores > 0.5) == y).mean() > 0.97
    for i in range(0, 800, 97):
        odds = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[i, f[node]] > c[node])
            odds += leaf[node - len(f)]
        assert abs(scores[i] - 1 / (1 + np.exp(-odds))) < 1e-12


def plain_gains(texts, word_discount, pair_discount):
    """Class-conditional Kneser-Ney in plain Python: a function of text, and each class's probabilities of the known words."""
    of = lambda t: set(zip([None, *t.split()], t.split()))
    n = [Counter(b for t, y in texts if y == c for b in of(t)) for c in (0, 1)]
    types, every = [Counter(w for _, w in n[c]) for c in (0, 1)], Counter(w for _, w in {*n[0], *n[1]})
    size = [max(sum(types[c].values()), 1) for c in (0, 1)]
    rest = [max(1 - sum(max(x - word_discount, 0) for x in types[c].values()) / size[c], toxicity.FLOOR) for c in (0, 1)]
    shared = lambda w: (every[w] + 0.5) / (sum(every.values()) + 0.5 * (len(every) + 2))
    p = lambda c, w: max(types[c][w] - word_discount, 0) / size[c] + rest[c] * shared(w)
    whole, own = [Counter(), Counter()], [Counter(), Counter()]
    for c in (0, 1):
        for (b, _), x in n[c].items():
            whole[c][b] += x
            own[c][b] += max(x - pair_discount, 0)

    def bigram(c, b, w):
        all_of = max(whole[c][b], 1)
        left = max(1 - own[c][b] / all_of, toxicity.FLOOR) if own[0][b] or own[1][b] else 1.0
        return max(n[c][b, w] - pair_discount, 0) / all_of + left * p(c, w)

    def sums(t):
        total = strong = 0.0
        for b, w in of(t):
            gain = np.log(bigram(1, b, w) / bigram(0, b, w))
            total += gain
            strong += max((gain if max(n[0][b, w], n[1][b, w]) > pair_discount else np.log(p(1, w) / p(0, w))) - toxicity.STRONG, 0)
        return len(of(t)), total, strong

    return sums, [[p(c, w) for w in every] + 2 * [rest[c] * shared("")] for c in (0, 1)]


@pytest.mark.parametrize("word_discount, pair_discount", [(4.0, 8.0), (0.75, 0.75), (2.0, 1.0)])
def test_sums_against_a_plain_kneser_ney(spark, word_discount, pair_discount):
    rng = np.random.default_rng(5)
    texts = [(" ".join(rng.choice(list("abcdefghij") if i % 3 else list("defghijklm"), 30)), int(i % 3 == 0)) for i in range(90)]
    plain, p = plain_gains(texts, word_discount, pair_discount)
    assert all(abs(sum(x) - 1) < 1e-9 for x in p)  # two halves of a count are for words that were never seen
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    given = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(docs, given, word_discount=word_discount, pair_discount=pair_discount, max_curve_rows=0)
    asked = [*(t for t, _ in texts), "", "zz", "a zz b zz a b", texts[0][0]]
    rows = model.sums(spark.createDataFrame(list(enumerate(asked)), "id int, text string")).collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert (r.n, r.total, r.strong) == pytest.approx(plain(asked[r.id]), abs=1e-3)


def test_rare_words_count_at_every_size(spark):
    # 40,000 common words in each class, and a word in 40 toxic texts of 800 only
    rng = np.random.default_rng(2)
    texts = [(i, " ".join([*(f"{chr(97 + a)}{chr(97 + b)}" for a, b in rng.integers(0, 26, (100, 2))), *(["rarebad"] * (i % 20 == 0))])) for i in range(800)]
    docs = spark.createDataFrame([*texts, (None, None), (900, ""), (0, texts[0][1]), (0, None)], "doc_id long, text string")
    given = labels(spark, [(i, 0, int(i % 4 == 0)) for i, _ in texts])
    seen = {}
    for held in (1_000_000, 250, 60):  # ranges of the entries: whatever their number, the scores are the same to the last bit
        model = toxicity.fit(docs, given, held=held)
        assert (model.passes == 1) == (held == 1_000_000) and model.passes * held >= model.entries.count()
        seen[held] = sorted((str(r.doc_id), r.score) for r in toxicity.score_toxicity(docs, model).collect())
    assert len(seen[60]) == 804 and seen[60] == seen[250] == seen[1_000_000]
    score = dict(seen[60])
    assert min(score[str(i)] for i, t in texts[1:] if "rarebad" in t) > max(score[str(i)] for i, t in texts if "rarebad" not in t and i % 4)


def test_all_labelled_texts_but_the_curves_are_counted(spark, monkeypatch):
    seen, count = [], toxicity._count
    monkeypatch.setattr(toxicity, "_count", lambda rows, *rest: (seen.append(rows.count()), count(rows, *rest))[1])
    docs = spark.createDataFrame([(i, f"some words of text {i % 7}") for i in range(3000)], "doc_id long, text string")
    for most, least in ((100, 2850), (20_000, 2250)):
        toxicity.fit(docs, labels(spark, [(i, 0, i % 2) for i in range(3000)]), max_curve_rows=most)
        assert least <= seen[-1] <= (2950 if most == 100 else 2550)


def test_language_edges(spark):
    docs = odd(spark)
    none = langid.identify(docs, langid.fit(docs.where("lang is null"))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, True)}
    one = langid.identify(docs, langid.fit(docs)).collect()
    assert {r.lang_pred for r in one if r.doc_id in (1, 2, 3)} == {"und"} and {r.lang_pred for r in one if r.doc_id in (4, 5)} == {"zz"}
    kept = langid.keep_identified(docs.withColumn("found", F.lit(1)), langid.fit(docs))
    assert kept.columns == ["doc_id", "text", "score", "lang", "found"] and kept.count() == 4
    assert langid.identify(docs.limit(0), {}).count() == 0
