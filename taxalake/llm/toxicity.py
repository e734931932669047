"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, score each text; its
toxicity follows from the difference of the two log-likelihoods per word, turned into
a probability by a logistic curve fitted on labelled texts that the models haven't seen.

A class's bigram counts are discounted and back off to the class's continuation counts
(in how many contexts a word occurs), and these, discounted as well, to the continuation
counts of both classes together, so that a rare expression is judged by counts that the
classes share.

Counting is done in Spark; it grows with the labels. A text counts, and is judged by,
each of its bigrams once, however often it repeats it. Every word and bigram above the
discounts, which are the same at every size, has its own entry; one that isn't above them
in either class would have no probability of its own anyway. Entries are a stored table in
the order of their hashes.

An entry is what it adds to a text's sums: a word its own gain, a context its backoff
weight, a bigram what it differs by from the two. So a text's sums are those of its entries
in any order, and scoring runs over ranges of the table: the tasks hold one range of about
``held`` entries at a time, and a range's sums of each text (whole numbers of 1 / UNIT) are
stored and added up. A range reaches the driver in Arrow pieces, 16 bytes an entry, and goes to
the tasks as one broadcast. Memory doesn't depend on the number of entries, no text or bigram is
shuffled, and scores don't depend on the number of ranges.

Results by case
    null text counts as empty; text without a word: the score of a difference of 0;
    no labels, or labels of one class only: every text gets the labels' smoothed share;
    labels that are null or other than 0 and 1, or whose document is missing: not used;
    several labels of one document: each counts; repeated rows: each is scored (rows of one id
    and text meet in one group as a count, and are put out again from it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import LETTERS, groups, mix, word_hashes

FLOOR = 1e-9
#: An expression speaks for a class of its own if it is so many times (as a logarithm) likelier there.
STRONG = 1.5
#: Texts are hashed in groups of about so many bytes.
GROUP = 1 << 22
#: What stands before a text's first word.
BEGIN = np.uint64(0x9E3779B97F4A7C15)
PAIR, CONTEXT, WORD = range(3)
#: Gains are whole numbers of 1 / UNIT, so that sums don't depend on their order.
UNIT = 1 << 20
#: About so many entries come to the driver at a time.
PIECE = 1 << 20


def _groups(texts: list[bytes]) -> Iterator[slice]:
    return groups([len(t) for t in texts], GROUP)


@dataclass
class Held:
    """A range of the entries: sorted hashes (signed), and what each adds."""

    hashes: np.ndarray
    total: np.ndarray
    strong: np.ndarray

    def add(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each of ``h`` adds (0 if it isn't here)."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        h = _signed(h)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.total[at], 0).astype(np.int64), np.where(known, self.strong[at], 0).astype(np.int64)


def _ranges(n: int, first: int = -(1 << 63), end: int = 1 << 63) -> list[tuple[int, int]]:
    """The first key and the end of each of ``n`` equal ranges of the keys from ``first`` to before ``end``."""
    step = -(-(end - first) // n)
    return [(k, min(k + step, end)) for k in range(first, end, step)]


def _held(entries: DataFrame, first: int, end: int, pieces: int) -> Held:
    """The entries from key ``first`` to before ``end``. They come in pieces and as Arrow whatever the session's
    settings are: as Python objects they take over 30 times their 16 bytes, and the driver's JVM holds them as rows too."""
    got: list[list[np.ndarray]] = [[], [], []]
    for low, high in _ranges(pieces, first, end):
        rows = entries.where(F.col("key").between(low, high - 1)).select("key", "total", "strong").toArrow()
        order = np.argsort(rows["key"].to_numpy())
        for column, to in zip(rows.columns, got):
            to.append(column.to_numpy()[order])
    return Held(*map(np.concatenate, got))


def _key(kind: int, h: np.ndarray) -> np.ndarray:
    """The key of a context or word among all entries."""
    return mix(h + np.uint64(kind))


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct bigrams: their keys, the words before and the words, and the texts' offsets."""
    word, offset = word_hashes(texts, LETTERS)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[offset[:-1][offset[1:] > offset[:-1]]] = BEGIN
    key = mix(mix(before) + word)
    text = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    order = np.lexsort((key, text))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(text[order]) != 0) | (key[order][1:] != key[order][:-1])
    own = order[new]
    return key[own], before[own], word[own], np.searchsorted(text[own], np.arange(len(offset)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _count(rows: DataFrame) -> DataFrame:
    """key, before, word, n0, n1: counts of bigrams by class. Each batch is summed before the shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, label = [(t or "").encode() for t in batch.column("text").to_pylist()], batch.column("y").to_numpy()
            for part in _groups(texts):
                key, before, word, offset = _pairs(texts[part])
                y = np.repeat(label[part], np.diff(offset))
                _, first, at = np.unique(key, return_index=True, return_inverse=True)
                n1 = np.bincount(at, y, len(first)).astype(np.int64)
                n = np.bincount(at, minlength=len(first)).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"before": _signed(before[first]), "word": _signed(word[first]), "n0": n - n1, "n1": n1}
                )

    counted = rows.select("text", "y").mapInArrow(batches, "before long, word long, n0 long, n1 long")
    return counted.groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _keyed(table: DataFrame, kind: int) -> DataFrame:
    """key, total and strong (in units) of a table of before, word, total and strong."""

    @F.pandas_udf(T.LongType())
    def key(before: pd.Series, word: pd.Series) -> pd.Series:
        b, w = (x.to_numpy(np.int64).view(np.uint64) for x in (before, word))
        return pd.Series(_signed({PAIR: lambda: mix(mix(b) + w), CONTEXT: lambda: _key(CONTEXT, b), WORD: lambda: _key(WORD, w)}[kind]()))

    units = [F.round(F.col(c) * UNIT).cast("int").alias(c) for c in ("total", "strong")]
    return table.select(key("before", "word").alias("key"), *units)


def _sums_of(held: Held):
    """A function of text: its number of distinct bigrams, and what the held entries add to its sums. (Spark
    broadcasts a function that holds much.)"""

    @F.pandas_udf("n long, total long, strong long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts, out = [(t or "").encode() for t in series], [np.zeros((0, 3), np.int64)]
            for part in _groups(texts):
                key, before, word, offset = _pairs(texts[part])
                total, strong = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
                for h in (key, _key(CONTEXT, before), _key(WORD, word)):
                    add = held.add(h)
                    total += add[0]
                    strong += add[1]
                sums = (np.diff(np.concatenate(([0], np.cumsum(x)))[offset]) for x in (total, strong))
                out.append(np.stack([np.diff(offset), *sums], axis=1))
            yield pd.DataFrame(np.concatenate(out), columns=["n", "total", "strong"])

    return udf


@dataclass
class Model:
    """``entries``: key, total and strong of every entry, by key; ``passes``: the number of ranges they are held in;
    ``unseen``: the gain of a word without an entry; ``curve``: intercept and weights of the logistic curve;
    ``pieces``: the number of parts in which a range comes to the driver."""

    entries: DataFrame
    passes: int
    unseen: float
    curve: np.ndarray
    pieces: int = 1

    def sums(self, rows: DataFrame) -> DataFrame:
        """id, n, total and strong of every row of ``rows`` (id, text): its distinct bigrams, the sum of their gains
        (toxic less ordinary), and of what of a gain is above STRONG."""
        found = []
        for i, (first, end) in enumerate(_ranges(self.passes)):
            held = _held(self.entries, first, end, self.pieces)
            made = rows.select("id", F.xxhash64("text").alias("k"), F.lit(int(i == 0)).alias("rows"), _sums_of(held)("text").alias("s"))
            found.append(common.stored(made.select("id", "k", "rows", "s.*"), "sums"))
        # rows of one id and text add up to a multiple of their sums
        each = reduce(DataFrame.union, found).groupBy("id", "k").agg(
            F.sum("rows").alias("rows"), F.max("n").alias("n"), F.sum("total").alias("total"), F.sum("strong").alias("strong")
        )
        base = {"total": self.unseen, "strong": max(self.unseen - STRONG, 0.0)}
        sums = [(F.col(c) / F.col("rows") / UNIT + F.col("n") * base[c]).alias(c) for c in base]
        return each.select("id", "n", *sums, F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("col")

    def inputs(self) -> list[Column]:
        """What the logistic curve sees of the sums of a text: 1, the difference of the log-likelihoods per word, the
        part of it that single expressions above STRONG make, and that part's logarithm as a sum."""
        n = F.greatest("n", F.lit(1.0))
        return [F.lit(1.0), F.col("total") / n, 10 * F.col("strong") / n, F.log1p("strong")]


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights by Newton steps, each halved until the penalised loss falls."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w = np.zeros(x.shape[1])
    w[0] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    keep = np.full(x.shape[1], l2)
    keep[0] = 0

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + (keep * w * w).sum() / 2

    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep + 1e-9), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        held: int = 4_000_000, word_discount: float = 4.0, pair_discount: float = 8.0,
        max_curve_rows: int = 20000) -> Model:
    """A model from all labelled rows: about ``max_curve_rows`` of them (by a hash of the id, at most
    a fifth) fit the logistic curve, and all others are counted. ``held``: how many entries the
    tasks hold at a time, about.

    The discounts are the counts that a class must exceed for an expression to have a
    probability of its own there; most words are rare, and a count of one or two says
    little about the class."""
    given = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    # always a sort-merge join: the labels' size has no bound, so they are not to be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(given.hint("merge"), "id")
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # rows of one id in one order at every run
    u = F.pmod(F.xxhash64("id", "y", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = common.stored(rows.select("text", "y", part.alias("part"), u.alias("u")), "labelled")
    share = min(0.2, max_curve_rows / max(rows.count(), 1))
    counted, curve_rows = rows.where(F.col("part") >= share), rows.where(F.col("part") < share)

    pairs = common.stored(_count(counted), "pairs")
    above = lambda c, d: F.greatest(F.col(c) - d, F.lit(0))
    types = [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"t{c}") for c in "01"]
    words = common.durable(pairs.groupBy("word").agg(F.count("*").alias("t"), F.sum(F.expr("n0 + n1")).alias("n"), *types))
    sums = [F.sum(x).alias(n) for n, x in (("t", "t"), ("t0", "t0"), ("t1", "t1"), ("o0", above("t0", word_discount)), ("o1", above("t1", word_discount)))]
    of = words.agg(F.count("*").alias("words"), *sums).first().asDict()
    of = {k: float(v or 0) for k, v in of.items()}
    rest = [max(1 - of[f"o{c}"] / max(of[f"t{c}"], 1.0), FLOOR) for c in "01"]
    shared = (F.col("t") + 0.5) / (of["t"] + 0.5 * (of["words"] + 2))
    p = [above(f"t{c}", word_discount) / max(of[f"t{c}"], 1.0) + rest[int(c)] * shared for c in "01"]
    words = words.select("word", "n", "t0", "t1", p[0].alias("p0"), p[1].alias("p1"))

    # a bigram or word above neither class's discount has the gain of its backoff
    contexts = pairs.groupBy("before").agg(
        F.sum(F.expr("n0 + n1")).alias("n"), *(F.greatest(F.sum(f"n{c}"), F.lit(1)).alias(f"whole{c}") for c in "01"),
        *(F.sum(above(f"n{c}", pair_discount)).alias(f"own{c}") for c in "01"),
    ).where("own0 > 0 or own1 > 0")
    left = [F.greatest(1 - F.col(f"own{c}") / F.col(f"whole{c}"), F.lit(FLOOR)).alias(f"left{c}") for c in "01"]
    contexts = common.durable(contexts.select("before", "n", "whole0", "whole1", *left))
    kept = pairs.where(F.greatest("n0", "n1") > pair_discount).join(contexts.drop("n").hint("merge"), "before")
    kept = kept.join(words.select("word", "p0", "p1").hint("merge"), "word")
    logs = [F.log(above(f"n{c}", pair_discount) / F.col(f"whole{c}") + F.col(f"left{c}") * F.col(f"p{c}")) for c in "01"]
    unseen = float(np.log(rest[1]) - np.log(rest[0]))
    excess = lambda c: F.greatest(c - STRONG, F.lit(0.0))
    none, word, context = F.lit(0).cast("long"), F.log("p1") - F.log("p0"), F.log("left1") - F.log("left0")
    own = logs[1] - logs[0]
    entries = (
        _keyed(kept.select("before", "word", (own - context - word).alias("total"), (excess(own) - excess(word)).alias("strong")), PAIR)
        .union(_keyed(contexts.select("before", none.alias("word"), context.alias("total"), F.lit(0.0).alias("strong")), CONTEXT))
        .union(_keyed(words.where(F.greatest("t0", "t1") > word_discount).select(
            none.alias("before"), "word", (word - unseen).alias("total"), (excess(word) - max(unseen - STRONG, 0.0)).alias("strong")), WORD))
    )
    entries = common.stored(entries.sort("key"), "entries")
    size = max(entries.count(), 1)
    passes = -(-size // held)
    model = Model(entries, passes, unseen, np.zeros(4), -(-size // (passes * PIECE)))

    number = curve_rows.count()
    # a bound only for ids whose rows repeat very often
    drawn = curve_rows.where(F.col("u") < 1.2 * max_curve_rows / max(number, 1))

    drawn = common.durable(drawn.select(F.xxhash64("text").alias("id"), "text", "y", "u"))
    found = model.sums(drawn.select("id", "text")).groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "total", "strong")))
    sample = drawn.select("id", "y", "u").join(found, "id").select("y", "u", F.array(*model.inputs()).alias("x"))
    sample = sample.toPandas().sort_values(["u", "y"], kind="stable")
    y = sample["y"].to_numpy(float)
    model.curve = _logistic(np.array(sample["x"].tolist()).reshape(len(y), 4), y)
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``id_col``, score and predicted (1 from ``least`` on) for every row of ``docs``."""
    z = sum((float(w) * x for w, x in zip(model.curve, model.inputs())), F.lit(0.0))
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    rows = model.sums(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).select(F.col("id").alias(id_col), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))
