"""Line dedup by a log-template tree.

Lines are parsed in a tree of fixed depth: first by their number of tokens, then by their
leading tokens, where a token with a digit or an @ counts as a variable field. A leaf
holds templates, each the line it began with; a line belongs to a template if at least
``similar`` of the places that aren't fields in both have that line's word, and half as
large a share of all places. A template never widens, whatever joins it. One that occurs in
at least ``min_docs`` documents is recurring; its lines are dropped from all of them but
the one with the smallest id, so that no text is lost altogether.

With ``long_docs``, a passage (a line of at least LONG_WORDS words or LONG_CHARS characters,
which counts for scripts without spaces) that occurs word for word in so many documents is
dropped from all but the first of them too.

Lines travel as hashes. Only leaves with several different lines are looked at closer;
equal lines are one row of a leaf however often they occur. A leaf's rows are dealt over
portions of about ``portion`` rows whose templates are then merged by the same rule; a
line follows its template into another one only if it is like that one's line as well.
A portion is read as a stream of which only its templates are kept. In a leaf of many
templates a line is held only against those that share one of its pieces: lines that
differ in d places share one of d + 1.

Results by case
    null text: null, no lines; empty text: empty; lines of fewer than ``min_tokens``
    tokens stay (all empty lines among them); rows with equal ids are one document;
    null ids are one document, the last; line breaks are single newlines;
    of a recurring line that the first document repeats, its repeats stay there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import PLAIN, groups, mix, word_places

DEPTH = 3
VARIABLE = np.uint64(0)  # the hash of a variable token
LONG_WORDS, LONG_CHARS = 50, 250
FEW = 64  # so many templates are all compared


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_FIELD = _flags(b"0123456789@")
_GROUP = 1 << 20


@dataclass
class Parsed:
    """The lines of some texts. By text: ``first``, the number of its first line (len + 1). By line: its
    number of tokens and where they begin in ``hashes``. ``which``: the lines that are parsed; by these
    ``text``, ``leaf`` and ``whole`` (the hash of the line). ``passages``: the long lines; by these
    ``exact`` (the hash of the line, fields as they are) and ``passage_text``."""

    first: np.ndarray
    number: np.ndarray
    begin: np.ndarray
    hashes: np.ndarray
    which: np.ndarray
    text: np.ndarray
    leaf: np.ndarray
    whole: np.ndarray
    passages: np.ndarray
    exact: np.ndarray
    passage_text: np.ndarray


def parse(texts: list[bytes], min_tokens: int, depth: int = DEPTH) -> Parsed:
    hashes, starts, raw, at = word_places(texts, PLAIN)
    as_is = hashes.copy()
    fields = np.flatnonzero(_FIELD[raw])
    if len(fields):
        hashes[np.searchsorted(starts, fields, "right") - 1] = VARIABLE
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, starts)
    number = np.bincount(line, minlength=len(breaks))
    begin = np.concatenate(([0], np.cumsum(number)))
    place = (np.arange(len(hashes)) - begin[line]).astype(np.uint64)
    running, running_as_is = (
        np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + mix(place + np.uint64(7))), dtype=np.uint64))) for h in (hashes, as_is)
    )
    which = np.flatnonzero(number >= min_tokens)
    n, b = number[which], begin[which]
    leaf = mix(n.astype(np.uint64))
    for d in range(depth):
        token = hashes[np.minimum(b + d, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(len(which), np.uint64)
        leaf = mix(leaf * np.uint64(31) + np.where(n <= d, np.uint64(1), token))
    whole = mix(running[b + n] - running[b] + leaf)
    first = np.searchsorted(breaks, at)
    chars = np.diff(np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)[breaks])))
    passages = np.flatnonzero((number >= LONG_WORDS) | ((chars > LONG_CHARS) & (number > 0)))
    n, b = number[passages], begin[passages]
    exact = mix(running_as_is[b + n] - running_as_is[b] + mix(n.astype(np.uint64) + np.uint64(11)))
    texts_of = [np.searchsorted(first, x, "right") - 1 for x in (which, passages)]
    return Parsed(first, number, begin, hashes, which, texts_of[0], leaf, whole, passages, exact, texts_of[1])


def _parsed(column, min_tokens: int) -> Iterator[tuple[int, Parsed]]:
    """Parsed texts of a batch, a group at a time, with the number of the group's first text."""
    texts = [(t or "").encode() for t in column]
    for part in groups([len(t) for t in texts], _GROUP):
        yield part.start, parse(texts[part], min_tokens)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _lines(docs: DataFrame, min_tokens: int) -> DataFrame:
    """k, z, leaf and line (a hash) of each distinct line of each text; passages once more, without leaf."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, p in _parsed(batch.column("text").to_pylist(), min_tokens):
                for hashes, of, leaf in ((p.whole, p.text, p.leaf), (p.exact, p.passage_text, None)):
                    order = np.lexsort((hashes, of))
                    text, line = of[order], hashes[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
                    rows, lines = pa.array(text[new] + at), pa.array(_signed(line[new]))
                    leaves = pa.nulls(len(lines), pa.int64()) if leaf is None else pa.array(_signed(leaf[order][new]))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k").take(rows), batch.column("z").take(rows), leaves, lines], names=["k", "z", "leaf", "line"]
                    )

    return docs.mapInArrow(batches, "k long, z boolean, leaf long, line long")


def _tokens(docs: DataFrame, min_tokens: int) -> DataFrame:
    """leaf, line and tokens (32-bit hashes) of each distinct line; a task sends a line's tokens once
    (or again after very many others)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in it:
            for _, p in _parsed(batch.column("text").to_pylist(), min_tokens):
                lines, index = np.unique(p.whole, return_index=True)
                new = np.array([x not in sent for x in lines.tolist()], bool)
                sent.update(lines[new].tolist())
                if len(sent) > 1 << 19:
                    sent.clear()
                index = index[new]
                number, begin = p.number[p.which[index]], p.begin[p.which[index]]
                ends = np.cumsum(number)
                flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - number), number)
                data = (p.hashes[flat] >> np.uint64(32)).astype(np.uint32)
                offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(p.leaf[index])), pa.array(_signed(p.whole[index])), tokens], names=["leaf", "line", "tokens"]
                )

    return docs.select("text").mapInArrow(batches, "leaf long, line long, tokens binary")


def _alike(known: np.ndarray, tokens: np.ndarray, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``known``: the alike places, those of them that are no fields, and whether the line belongs to it."""
    equal = known == tokens
    alike, fixed = equal.sum(axis=1), (equal & (tokens != 0)).sum(axis=1)
    words = len(tokens) - (alike - fixed)
    return alike, fixed, (fixed >= similar * words - 1e-9) & (fixed >= similar * len(tokens) / 2)


class Leaf:
    """Templates of one leaf, each the line it began with, as rows of token hashes in which 0 is a field."""

    def __init__(self, size: int, similar: float):
        self.similar, self.count = similar, 0
        self.names: list[int] = []
        self.table = np.zeros((4, size), np.uint32)
        # the leading tokens are the leaf's, so the pieces are of the others
        pieces = int((1 - similar) * size + 1e-9) + 1
        self.cuts = np.linspace(min(DEPTH, size), size, pieces + 1).astype(int).tolist()
        self.by_piece: dict[tuple[int, bytes], list[int]] = {}
        self.indexed = 0

    def _pieces(self, tokens: np.ndarray) -> list[tuple[int, bytes]]:
        return [(a, tokens[a:b].tobytes()) for a, b in zip(self.cuts, self.cuts[1:])]

    def _near(self, tokens: np.ndarray) -> np.ndarray:
        """The templates that the line may belong to."""
        if self.count <= FEW:
            return np.arange(self.count)
        for i in range(self.indexed, self.count):
            for key in self._pieces(self.table[i]):
                self.by_piece.setdefault(key, []).append(i)
        self.indexed = self.count
        return np.array(sorted({i for key in self._pieces(tokens) for i in self.by_piece.get(key, ())}), dtype=np.int64)

    def place(self, name: int, tokens: np.ndarray) -> int:
        """The number of the template that the line belongs to: a new one's name is the line's own."""
        near = self._near(tokens)
        alike, fixed, belongs = _alike(self.table[near], tokens, self.similar)
        if belongs.any():
            near, alike, fixed = near[belongs], alike[belongs], fixed[belongs]
            return int(near[np.lexsort((fixed, alike))[-1]])
        if self.count == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.count] = tokens
        self.count += 1
        self.names.append(name)
        return self.count - 1


def _grow(rows: DataFrame, similar: float, merge: bool = False) -> DataFrame:
    """Streams rows (leaf, part, parts, line, tokens; sorted, all of a leaf's part in one task) through the tree;
    gives leaf, line and its template. For a leaf of several parts, the line's tokens stand in ``tokens`` and
    templates have a row of their own; with ``merge``, ``root`` has the template's tokens."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf, parts = None, None, 0
        out: list[list] = [[], [], [], [], []]

        def put(*row) -> None:
            for c, v in zip(out, row):
                c.append(v)

        def close() -> None:
            if leaf is not None and parts > 1 and not merge:
                for i, name in enumerate(leaf.names):
                    put(at[0], name, name, leaf.table[i].tobytes(), None)

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            made = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds)], names=["leaf", "line", "template", "tokens", "root"]
            )
            for c in out:
                c.clear()
            return made

        before = None
        for batch in it:
            for key in zip(*(batch.column(c).to_pylist() for c in ("leaf", "part", "line", "parts", "tokens"))):
                if key[:3] == before:
                    continue
                tokens = np.frombuffer(key[4], np.uint32)
                if key[:2] != at:
                    close()
                    at, leaf, parts = key[:2], Leaf(len(tokens), similar), key[3]
                i = leaf.place(key[2], tokens)
                if leaf.names[i] != key[2]:
                    own = key[4] if parts > 1 and not merge else None
                    put(key[0], key[2], leaf.names[i], own, leaf.table[i].tobytes() if merge else None)
                before = key[:3]
            if out[0]:
                yield flush()
        close()
        yield flush()

    dealt = rows.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "line")
    kinds = "leaf long, line long, template long, tokens binary, root binary"
    return dealt.select("leaf", "part", "line", "parts", "tokens").mapInArrow(batches, kinds)


def _belongs(similar: float):
    """A function of the tokens of two lines: whether the first belongs to the second's template."""

    @F.pandas_udf(T.BooleanType())
    def udf(tokens: pd.Series, root: pd.Series) -> pd.Series:
        lines = ((np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)) for a, b in zip(tokens, root))
        return pd.Series([bool(_alike(b[None, :], a, similar)[2][0]) for a, b in lines], dtype=bool)

    return udf


def recurring(docs: DataFrame, min_docs: int, min_tokens: int, similar: float, portion: int, long_docs: int | None = None) -> DataFrame:
    """k, z, lines: for each document that loses lines, their hashes. ``docs``: k, z, text."""
    docs = docs.where("text is not null")
    lines = _lines(docs, min_tokens)
    has = common.durable(lines if long_docs else lines.where("leaf is not null"))
    passages, has = has.where("leaf is null"), has.where("leaf is not null")
    several = has.groupBy("leaf", "line").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.sum("one").alias("n")).where("n > 1")
    close = _tokens(docs, min_tokens).join(several, "leaf")
    close = close.withColumn("parts", F.expr(f"n div {portion} + 1")).withColumn("part", F.pmod(F.xxhash64("line"), "parts"))
    first = common.durable(_grow(close, similar))
    # templates of a leaf's portions meet; a leaf that was one portion is not looked at again
    zero = F.lit(0).cast("long")
    merged = _grow(first.where("line = template").withColumns({"part": zero, "parts": zero}), similar, merge=True)
    merged = common.durable(merged.select("line", "template", "root"))
    moved = first.where("line <> template and tokens is not null").select("line", "template", "tokens").join(
        merged.select(F.col("line").alias("template"), F.col("template").alias("other"), "root"), "template"
    )
    moved = moved.where(_belongs(similar)("tokens", "root")).select("line", F.col("other").alias("root"))
    named = first.where("line <> template").select("line", "template").join(moved, "line", "left")
    named = named.select("line", F.coalesce("root", "template").alias("root"))
    roots = named.union(merged.select("line", F.col("template").alias("root")))

    has = has.join(roots, "line", "left").select("k", "z", "line", F.coalesce("root", "line").alias("root"))

    def repeated(lines: DataFrame, least: int) -> DataFrame:
        spread = lines.groupBy("root", "k", "z").agg(F.count("*").alias("n")).groupBy("root").agg(
            F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.min(F.struct("z", "k")).alias("first")
        )
        often = common.durable(spread.where(F.col("n_docs") >= least).select("root", "n", "first"))
        found = common.spread_join(lines, often, "root", "n")
        return found.where(F.struct("z", "k") != F.col("first")).select("k", "z", "line")

    lost = repeated(has, min_docs)
    if long_docs:
        lost = lost.union(repeated(passages.select("k", "z", "line", F.col("line").alias("root")), long_docs))
    return lost.groupBy("k", "z").agg(F.collect_set("line").alias("lines"))


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("dropped", T.IntegerType())])


def _without(min_tokens: int):
    """A function of text and line hashes: the text without those lines, and their number."""

    @F.pandas_udf(_CUT)
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lost in batches:
            held = [i for i, (t, gone) in enumerate(zip(texts, lost)) if t is not None and gone is not None]
            out = [(t, 0) for t in texts]
            for at, p in _parsed([texts.iloc[i] for i in held], min_tokens):
                ends, long_ends = (np.searchsorted(x, np.arange(len(p.first))) for x in (p.text, p.passage_text))
                for j in range(len(p.first) - 1):
                    i, own = held[at + j], slice(ends[j], ends[j + 1])
                    long, names = slice(long_ends[j], long_ends[j + 1]), np.asarray(lost.iloc[i], np.int64)
                    drop = set((p.which[own][np.isin(p.whole[own].view(np.int64), names)] - p.first[j]).tolist())
                    drop.update((p.passages[long][np.isin(p.exact[long].view(np.int64), names)] - p.first[j]).tolist())
                    lines = texts.iloc[i].split("\n")
                    out[i] = ("\n".join(x for n, x in enumerate(lines) if n not in drop), len(drop))
            yield pd.DataFrame(out, columns=["text", "dropped"])

    return udf


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 3, min_tokens: int = 3,
    similar: float = 0.8, portion: int = 50000, long_docs: int | None = None,
) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without the lines of recurring templates, and the new
    columns ``n_lines`` and ``n_dropped`` (before and in the text; named apart if the names are taken)."""
    k, z, lost_at, cut = (common.fresh(docs, f"__{n}") for n in ("k", "z", "lines", "cut"))
    key = common.plain_key(F.col(id_col))
    rows = docs.select(key["k"].alias("k"), key["z"].alias("z"), F.col(text).alias("text"))
    lost = recurring(rows, min_docs, min_tokens, similar, portion, long_docs).toDF(k, z, lost_at)
    marked = docs.withColumns({k: key["k"], z: key["z"]}).join(lost, [k, z], "left")
    udf = _without(min_tokens)
    made = F.when(F.col(lost_at).isNotNull(), udf(F.when(F.col(lost_at).isNotNull(), F.col(text)), F.col(lost_at)))
    marked = marked.withColumn(cut, made)
    n_lines, n_dropped = common.fresh(docs, "n_lines"), common.fresh(docs, "n_dropped")
    kept = [F.when(F.col(lost_at).isNull(), F.col(c)).otherwise(F.col(f"{cut}.text")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    lines = F.when(F.col(text) != "", F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    return marked.select(
        *kept, F.coalesce(lines, F.lit(0)).alias(n_lines), F.coalesce(F.col(f"{cut}.dropped"), F.lit(0)).alias(n_dropped)
    )
