"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be found in a document with up to k = floor(rate * m)
edits. Cut into k + 1 pieces, one piece at least is then found exactly. One automaton
holds all pieces; every hit gives a window of the document in which Myers' bit-parallel
algorithm finds the item's least edit distance, first of the piece with its neighbours. Texts are compared by their letters and
digits in lower case, every run of other characters being one space.

The items are the query set: they are taken in blocks of at most ``block_bytes``, and
each block is held against all documents in one pass. A block with its automaton is all
that the driver or a task holds of the benchmark.

Results by case
    null text, or text without letter or digit: matches nothing; an item whose normal
    form is shorter than ``least_chars`` is no evidence and is not searched; equal items
    are found under each of their ids; null ids are kept;
    equal distances: the earliest end counts; repeated rows: each has its own result rows;
    empty documents or benchmark: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

_GAP = re.compile(r"[\W_]+")
_RUN = re.compile(r"[^\W_]+")
RATE = 0.08
LEAST_CHARS = 25
BLOCK_BYTES = 1 << 20


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


class Pattern:
    """A string with the bit masks of its characters, forwards and backwards."""

    def __init__(self, text: str):
        self.text = text
        self.tables: tuple[dict[str, int], dict[str, int]] | None = None

    def _masks(self, backwards: bool) -> dict[str, int]:
        if self.tables is None:
            both = []
            for t in (self.text, self.text[::-1]):
                at: dict[str, int] = {}
                for i, c in enumerate(t):
                    at[c] = at.get(c, 0) | 1 << i
                both.append(at)
            self.tables = (both[0], both[1])
        return self.tables[backwards]

    def best(self, window: str, backwards: bool = False) -> tuple[int, int]:
        """Least edit distance between the text and a part of ``window``, and where (after
        which character) that part first ends. ``backwards``: the text reversed."""
        masks, m = self._masks(backwards), len(self.text)
        full, last = (1 << m) - 1, 1 << (m - 1)
        up, down, score = full, 0, m
        least, end = m, 0
        for i, c in enumerate(window, 1):
            eq = masks.get(c, 0)
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus = down | (full & ~(across | up))
            minus = up & across
            if plus & last:
                score += 1
            elif minus & last:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up = minus | (full & ~(vertical | plus))
            down = plus & vertical
            if score < least:
                least, end = score, i
        return least, end


class Item(Pattern):
    """A normalised item with its error budget and pieces.

    The pieces are the leaves of a binary tree. If p + q pieces are matched with at most
    p + q - 1 edits, then the first p with at most p - 1 or the last q with at most q - 1;
    so some exact piece lies below nodes that all keep to such budgets, and a chance hit
    is mostly refuted by its parent, a pattern of two pieces."""

    def __init__(self, ids: list, text: str, rate: float):
        super().__init__(text)
        self.ids, self.budget = ids, int(rate * len(text))
        n, k = len(text), self.budget + 1
        self.edges = [n * i // k for i in range(k + 1)]
        self.nodes: dict[tuple[int, int], Pattern] = {}

    def pieces(self) -> Iterator[tuple[str, int]]:
        for i, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            yield self.text[a:b], i

    def _above(self, piece: int) -> list[tuple[int, int]]:
        """Nodes (first piece, end) above a piece, the smallest first, without the root."""
        a, b, path = 0, self.budget + 1, []
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (a, middle) if piece < middle else (middle, b)
            path.append((a, b))
        return path[-2::-1]

    def holds(self, text: str, begin: int, piece: int) -> bool:
        """Whether all nodes above ``piece`` are matched within their budgets, where the item would begin at ``begin``."""
        for a, b in self._above(piece):
            if (a, b) not in self.nodes:
                self.nodes[a, b] = Pattern(self.text[self.edges[a] : self.edges[b]])
            edits = b - a - 1
            window = text[max(0, begin + self.edges[a] - edits) : max(0, begin + self.edges[b] + edits)]
            if self.nodes[a, b].best(window)[0] > edits:
                return False
        return True


class Block:
    """Items of one pass and the automaton of their pieces."""

    def __init__(self, items: Iterable[tuple[object, str]], rate: float):
        by_text: dict[str, list] = {}
        for i, t in items:
            by_text.setdefault(t, []).append(i)
        self.items = [Item(by_text[t], t, rate) for t in sorted(by_text)]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for piece, at in item.pieces():
                places.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[Item, int, int, int]]:
        """Item, distance, start and end in ``text`` of each item's best match within its budget."""
        windows: dict[int, list[list[int]]] = {}
        for last, (size, found) in self.automaton.iter(text):
            for n, at in found:
                item = self.items[n]
                begin = last + 1 - size - item.edges[at]
                if not item.holds(text, begin, at):
                    continue
                a, b = max(0, begin - item.budget), min(len(text), begin + len(item.text) + item.budget)
                kept = windows.setdefault(n, [])
                if kept and a <= kept[-1][1]:
                    kept[-1][0], kept[-1][1] = min(a, kept[-1][0]), max(b, kept[-1][1])
                else:
                    kept.append([a, b])
        out = []
        for n in sorted(windows):
            item = self.items[n]
            least, span = item.budget + 1, (0, 0)
            for a, b in windows[n]:
                if b - a < len(item.text) - item.budget:
                    continue
                at = text.find(item.text, a, b)
                if at >= 0:
                    least, span = 0, (at, at + len(item.text))
                    break
                distance, end = item.best(text[a:b])
                if distance < least:
                    back = item.best(text[a : a + end][::-1], backwards=True)[1]
                    least, span = distance, (a + end - back, a + end)
            if least <= item.budget:
                out.append((item, least, *span))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text: str, least_chars: int, block_bytes: int) -> Iterator[list[tuple]]:
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    block, size = [], 0
    for r in rows.toLocalIterator():
        t = normal(r["t"])
        if len(t) < least_chars:
            continue
        block.append((r["i"], t))
        size += len(t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _places(text: str) -> list[tuple[int, int, int]]:
    """Of each run of letters and digits: where it begins in the normal form, begins and ends in ``text``."""
    out, at = [], 0
    for m in _RUN.finditer(text):
        out.append((at, m.start(), m.end()))
        at += len(m.group().lower()) + 1
    return out


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
    item_text: str = "text", rate: float = RATE, least_chars: int = LEAST_CHARS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and item found in it: ``id_col``, ``item_col``, distance, budget
    (edits allowed), start and end (code points of the text)."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__text"))
    item_type = benchmark.schema[item_col].dataType
    ids = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {item_type.simpleString()}"
    schema = f"{ids}, distance int, budget int, start int, end int"

    def scan(items: list[tuple]) -> DataFrame:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(items, rate)
            for batch in it:
                out: list[tuple] = []
                for i, t in zip(batch.column(0), batch.column(1)):
                    t = t.as_py()
                    if not t:
                        continue
                    found = block.matches(normal(t))
                    places = _places(t) if found else []
                    for item, distance, a, b in found:
                        start = max((p for p in places if p[0] <= a), default=places[0])[1]
                        end = max((p for p in places if p[0] < b), default=places[0])[2]
                        out += [(i.as_py(), k, distance, item.budget, start, end) for k in item.ids]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        names = [id_col, item_col, "distance", "budget", "start", "end"]
        types = [to_arrow_type(docs.schema[id_col].dataType), to_arrow_type(item_type), *[pa.int32()] * 4]
        return rows.mapInArrow(batches, schema)

    found, last = None, None
    for items in _blocks(benchmark, item_col, item_text, least_chars, block_bytes):
        if last is not None:  # a former block's pass is done and kept before the next block is read
            kept = common.durable(scan(last))
            found = kept if found is None else found.union(kept)
        last = items
    if last is None:
        return scan([]).limit(0)
    return scan(last) if found is None else found.union(scan(last))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_col: str = "item_id",
          **options) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is found.

    Each block but the last makes a pass that keeps the hashes of the texts it found items in (twice 64
    bits), before the next block is read; these texts' rows go by one anti join. The last block filters."""
    rate, least = options.get("rate", RATE), options.get("least_chars", LEAST_CHARS)
    hashes = [F.xxhash64(F.lit(k), F.col(text)) for k in (1, 2)]
    dirty, last = None, None
    for items in _blocks(benchmark, item_col, item_text, least, options.get("block_bytes", BLOCK_BYTES)):
        if last is not None:
            found = docs.where(_contains(last, rate, F.col(text))).select(*[h.alias(f"__h{k}") for k, h in enumerate(hashes)])
            found = common.durable(found.distinct())
            dirty = found if dirty is None else dirty.union(found)
        last = items
    if last is None:
        return docs
    out = docs
    if dirty is not None:
        out = out.join(dirty.distinct().hint("merge"), (hashes[0] == F.col("__h0")) & (hashes[1] == F.col("__h1")), "left_anti")
    return out.where(~_contains(last, rate, F.col(text)))


def _contains(items: list[tuple], rate: float, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = Block(items, rate)
        for texts in batches:
            yield pd.Series([bool(t) and bool(block.matches(normal(t))) for t in texts], dtype=bool)

    return udf(text)
