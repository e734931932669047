"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are counts and shares of characters, words and lines of
the whole text. Trees are complete and of one depth, grown level by level on binned
statistics, and kept as flat arrays, so that a batch of texts goes through all trees
with a few numpy steps.

Results by case
    null text counts as empty; empty text has statistics 0 and gets a score like any;
    no labelled rows: score 0.5 for every row; labels of one class: its smoothed share;
    labels that are null or other than 0 and 1, or whose document is missing: not used;
    several labels of one document: each is a training row;
    repeated rows: each is scored; other columns have no effect.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "upper", "digits", "spaces",
    "sentence_marks", "exclamations", "bars", "symbols", "brackets", "quotes", "non_ascii", "high_bytes_per_word",
    "distinct_words", "distinct_pairs", "top_word", "words_without_letter", "words_with_symbol", "capital_words",
    "log_lines", "line_words", "distinct_lines", "short_lines", "marked_line_ends",
)
_LETTER = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")


def _classes() -> np.ndarray:
    """For each byte, the statistic that counts it (0 to 10)."""
    kind = np.zeros(256, dtype=np.int64)
    for k, chars in enumerate(
        (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?",
         b"!", b"|", b"#$%&*+=~^@/\\_", b"()[]{}<>", b"'\"`"), 1,
    ):
        kind[list(chars)] = k
    kind[128:] = 11
    return kind


_KIND = _classes()


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    n = len(raw)
    by = np.zeros(12)
    for i in range(0, n, 1 << 20):
        by += np.bincount(_KIND[raw[i : i + (1 << 20)]], minlength=12)
    words = text.split()
    w = max(1, len(words))
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    bare = odd = 0
    for x, k in seen.items():
        if not x.isalpha():
            bare += k * (not _LETTER.search(x))
            odd += k * bool(_ODD.search(x))
    return [
        np.log1p(n), np.log1p(len(words)), sum(len(x) * k for x, k in seen.items()) / w, max(map(len, seen), default=0),
        (by[1] + by[2]) / n, by[2] / max(1.0, by[1] + by[2]), by[3] / n, by[4] / n,
        by[5] / n, by[6] / n, by[7] / n, by[8] / n, by[9] / n, by[10] / n, by[0] / n, by[11] / w,
        len(seen) / w, pairs / max(1, len(words) - 1), max(seen.values(), default=0) / w, bare / w, odd / w,
        sum(k for x, k in seen.items() if x[0].isupper()) / w,
        np.log1p(len(lines)), w / m, len(set(lines)) / m, sum(len(x) < 30 for x in lines) / m,
        sum(x.rstrip()[-1] in ".!?" for x in lines) / m,
    ]


@dataclass
class Trees:
    """Complete trees of one depth: ``feature`` and ``cut`` by tree and inner node
    (children of node i are 2i + 1, right if the value is above the cut, and so 2i + 2),
    ``leaf`` by tree and leaf, and the log-odds before the first tree."""

    base: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        odds = np.full(len(x), self.base)
        if len(self.feature):
            row, tree = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
            node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
            odds += self.leaf[tree, node - (2**self.depth - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-odds))


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0,
    least: int = 4,
) -> Trees:
    """Boosted trees for labels ``y`` (0 or 1) under logistic loss.

    Each level of a tree sums gradients and Hessians by (node, statistic, bin) with one
    bincount a statistic, and cuts every node where the gain is largest."""
    if not len(y):
        return Trees(0.0, depth, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    if share * len(y) < 1 or (1 - share) * len(y) < 1:
        return Trees(base, depth, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    n, p = x.shape
    odds = np.full(n, base)
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-odds))
        grad, hess = y - prob, prob * (1 - prob)
        node = np.zeros(n, dtype=np.int64)
        f_t, c_t = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = node - first
            best = np.zeros(width)
            split = np.full(n, bins + 1)
            chosen = np.zeros(width, dtype=np.int64)
            where = np.full(width, bins + 1)
            total_g, total_h = np.bincount(at, grad, width), np.bincount(at, hess, width)
            whole = total_g**2 / (total_h + l2)
            for j in range(p):
                key = at * bins + binned[:, j]
                g, h, k = (np.bincount(key, v, width * bins).reshape(width, bins).cumsum(axis=1) for v in (grad, hess, None))
                rest = k[:, -1:] - k
                gain = g**2 / (h + l2) + (total_g[:, None] - g) ** 2 / (total_h[:, None] - h + l2) - whole[:, None]
                gain[(k < least) | (rest < least)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best + 1e-12
                best[better], chosen[better], where[better] = gain[np.arange(width), top][better], j, top[better]
            for i in np.flatnonzero(where <= bins):
                f_t[first + i], c_t[first + i] = chosen[i], cuts[chosen[i]][where[i]]
            split = where[at]
            node = 2 * node + 1 + (binned[np.arange(n), chosen[at]] > split)
        at = node - (2**depth - 1)
        value = rate * np.bincount(at, grad, 2**depth) / (np.bincount(at, hess, 2**depth) + l2)
        odds += value[at]
        feature.append(f_t)
        cut.append(c_t)
        leaf.append(value)
    return Trees(base, depth, np.array(feature), np.array(cut), np.array(leaf))


def _table(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(FEATURES))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return pd.Series(list(_table(texts)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        max_rows: int = 30000, **options) -> Trees:
    """Trees learned from about ``max_rows`` different rows (id and label) of ``labels`` (all, if there are
    fewer), chosen by a hash of the id.

    The bound is what makes it safe to broadcast the chosen ids and to bring their
    statistics (not their texts) to the driver."""
    given = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).distinct()
    share = min(1.0, max_rows / max(given.count(), 1))
    drawn = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), "id")
    found = rows.select("id", "y", statistics_of("text").alias("x")).toPandas().sort_values(["id", "y"], kind="stable")
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES))
    return grow(x, found["y"].to_numpy(), **options)


def score(trees: Trees, text: Column) -> Column:
    """Probability that a text's label is 1."""

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(trees.scores(_table(texts)))

    return udf(text)


def score_quality(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``id_col``, score and predicted (1 from ``least`` on) for every row of ``docs``."""
    rows = docs.select(F.col(id_col), score(trees, F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= least).cast("int"))
