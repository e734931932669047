"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word n-grams, as 64-bit hashes. The n-grams have a
global order and are cut into fragments of it (ranges of the hash), so that a document is
a segment in each fragment. For a pair of documents the overlap of the segments is
counted in each fragment by itself, and the counts are summed; a pair is a link if

    100 * intersection >= percent * union.

Which pairs are counted is decided without loss in three steps:

1. Equal sets are one node. In the first fragment alone, the n-grams that no other
   document has are counted. A node with more of them than (100 - percent) % of its size
   has no partner.
2. Among the nodes left, n-grams are ordered by the number of nodes that have them. The
   n-grams from the i-th of a node's set on, in this order, are an upper bound of what it
   can share with another node if the i-th is the first that they share. So a node is
   looked up only by n-grams whose rest is large enough, and two nodes that meet are a
   candidate only if both rests reach the overlap that their sizes demand.
3. In each list of nodes with one n-gram, all are first held against one of them. The
   links found make components; then only nodes outside their list's largest component
   are held against the nodes of other components. Pairs within a component need no
   count, so thousands of near copies are not held against each other.

Results by case
    null or empty text, or no word: the empty set, linked with nothing, component its own id;
    fewer words than n: the whole sequence is the only n-gram;
    repeated rows and copies: one node, one component; rows with equal ids but other texts
    are nodes of their own; null id: size given, component null;
    hashes are 64 bits; two n-grams or two sets are confused with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import components
from .words import PLAIN, grams, groups, mix, word_hashes

FRAGMENTS = 16
#: The first fragment for step 1 is this share of the order.
SCREEN = 4
_GROUP = 1 << 20


def _sets(texts: list, n: int) -> Iterator[np.ndarray]:
    """The sorted n-gram hashes of each text, a few texts at a time."""
    for part in groups([len(t) for t in texts], _GROUP):
        words, offset = word_hashes(texts[part], PLAIN)
        runs = grams(words, n)  # those that run over the end of a text are left out below
        for a, b in zip(offset.tolist(), offset[1:].tolist()):
            own = runs[a : b - n + 1] if b - a >= n else grams(words[a:b], n)
            if len(own) < 2:
                yield own
                continue
            own = np.sort(own)
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]


def _node(s: np.ndarray) -> int:
    """A hash of a set."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def _screened(s: np.ndarray) -> np.ndarray:
    return s[: np.searchsorted(s, np.uint64((1 << 64) // SCREEN))]


def sizes(docs: DataFrame, n: int) -> DataFrame:
    """id, size, node (null for the empty set) and size in the first fragment of each row. ``docs``: id, text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [(len(s), _node(s) if len(s) else None, len(_screened(s))) for s in _sets(_bytes(batch.column("text")), n)]
            size, node, part = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(part, pa.int64())],
                names=["id", "size", "node", "part"],
            )

    return docs.select("id", "text").mapInArrow(batches, "id long, size long, node long, part long")


def _entries(texts: DataFrame, n: int, screen: bool) -> DataFrame:
    """gram and node for every n-gram (of the first fragment) of every text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made, nodes, size = [], [], 0

            def flush() -> pa.RecordBatch:
                out = np.concatenate(made) if made else np.zeros(0, np.uint64)
                node = np.repeat(np.array(nodes, np.int64), [len(x) for x in made]) if made else np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(node)], names=["gram", "node"])

            for s in _sets(_bytes(batch.column("text")), n):
                if not len(s):
                    continue
                made.append(_screened(s) if screen else s)
                nodes.append(_node(s))
                size += len(made[-1])
                if size > 1 << 18:
                    yield flush()
                    made, nodes, size = [], [], 0
            yield flush()

    return texts.select("text").mapInArrow(batches, "gram long, node long")


def _segments(texts: DataFrame, n: int) -> DataFrame:
    """node, fragment and its n-grams."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(1 << 64) * i // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
        for batch in it:
            for s, node in zip(_sets(_bytes(batch.column("text")), n), batch.column("node").to_pylist()):
                at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
                full = np.flatnonzero(np.diff(at))
                parts = pa.ListArray.from_arrays(
                    pa.array(np.concatenate((at[full], at[-1:])), pa.int32()), pa.array(s.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(full), node)), pa.array(full.astype(np.int32)), parts], names=["node", "fragment", "grams"]
                )

    return texts.select("node", "text").mapInArrow(batches, "node long, fragment int, grams array<long>")


def _candidates(docs: DataFrame, sized: DataFrame, n: int, percent: int) -> DataFrame:
    """Step 1: node, size and text of the nodes that may have a partner."""
    entries = _entries(docs, n, True)
    shared = entries.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    shared = entries.join(shared, "gram").groupBy("node").agg(F.count("*").alias("shared"))
    nodes = sized.where("node is not null and id is not null").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("id").alias("id"), F.first("size").alias("size"), F.first("part").alias("part")
    )
    alone = F.col("part") - F.coalesce("shared", F.lit(0))
    left = nodes.join(shared, "node", "left").where(
        (F.col("copies") > 1) | (alone * 100 <= F.col("size") * (100 - percent))
    )
    picked = docs.join(left.select("id", "node", "size"), "id").select("node", "size", "text")
    return _own(picked, n).dropDuplicates(["node"])


def _own(rows: DataFrame, n: int) -> DataFrame:
    """Those ``rows`` whose text makes their node (rows with equal ids may have other texts)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nodes = batch.column("node").to_pylist()
            kept = [len(s) > 0 and _node(s) == k for s, k in zip(_sets(_bytes(batch.column("text")), n), nodes)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(batches, rows.schema)


def _demand(a: Column, b: Column, percent: int) -> Column:
    """Smallest intersection times (100 + percent) of two linked sets of these sizes."""
    return (a + b) * percent


def _lists(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Step 2: gram, node, size and rest, for each n-gram by which a node is looked up."""
    entries = _entries(texts, n, False)
    counts = entries.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1")
    shared = entries.join(counts, "gram")
    of_node = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.row_number().over(of_node.orderBy("c", "gram"))).withColumn(
        "rest", F.count("*").over(of_node) - F.col("rank") + 1
    )
    ranked = ranked.join(texts.select("node", "size"), "node")
    return ranked.where(F.col("rest") * 100 >= F.col("size") * percent).select("gram", "node", "size", "rest")


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sum of their overlaps over the fragments."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    met = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
    partial = met.select("a", "b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("overlap"))
    return partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, size_a, size_b) that are links."""
    counted = pairs.join(_overlaps(pairs, segments), ["a", "b"])
    union = F.col("size_a") + F.col("size_b") - F.col("overlap")
    return counted.where(F.col("overlap") * 100 >= union * percent).select("a", "b")


def _met(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Distinct candidates (a < b with their sizes) from rows x and y of equal ``gram``."""
    x, y = x.alias("x"), y.alias("y")
    enough = F.least("x.rest", "y.rest") * (100 + percent) >= _demand(F.col("x.size"), F.col("y.size"), percent)
    differ = F.col("x.node") != F.col("y.node")
    if "component" in x.columns:
        differ = differ & (F.col("x.component") != F.col("y.component"))
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & differ & enough)
    low = F.col("x.node") < F.col("y.node")
    return pairs.select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
        F.when(low, F.col("x.size")).otherwise(F.col("y.size")).alias("size_a"),
        F.when(low, F.col("y.size")).otherwise(F.col("x.size")).alias("size_b"),
    ).distinct()


def links(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between the nodes of ``texts`` (node, size, text) that suffice to connect all
    nodes that links connect: steps 2 and 3."""
    lists = common.durable(_lists(texts, n, percent))
    segments = _segments(texts, n)
    heads = lists.groupBy("gram").agg(F.max(F.struct("rest", "node", "size")).alias("h"), F.count("*").alias("c"))
    heads = heads.where("c > 1").select("gram", "h.*")
    first_pairs = common.durable(_met(heads, lists, percent))
    first = common.durable(_linked(first_pairs, segments, percent))

    placed = lists.join(components(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = common.durable(placed)
    by_component = placed.groupBy("gram", "component").agg(F.count("*").alias("c"))
    largest = by_component.groupBy("gram").agg(
        F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("several")
    ).where("several > 1").select("gram", F.col("m.component").alias("main"))
    open_ = placed.join(largest, "gram")
    minor = open_.where("component <> main").drop("main")
    rest = _met(minor, open_.drop("main"), percent).join(first_pairs.select("a", "b"), ["a", "b"], "left_anti")
    return first.union(_linked(common.durable(rest), segments, percent))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """``id_col``, n_shingles (size of the set), component_id (smallest id that links reach) and
    n_copies (rows with the same set, itself included) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sized = common.durable(sizes(rows, n))
    texts = common.durable(_candidates(rows.where("id is not null"), sized, n, percent))
    found = common.durable(links(texts, n, percent))

    named = sized.where("node is not null").join(components(found), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    copies = named.groupBy("node").agg(F.count("*").alias("n_copies"), F.first("component").alias("component"))
    places = copies.join(least, "component").select("node", "n_copies", "component_id")
    out = sized.join(places, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without those that links connect to a row of a smaller id;
    of rows equal in id and text one stays. An id whose rows have several texts goes if all of
    them are so connected. Rows of null id stay (of such as are equal in text, one)."""
    k, z, same, at = (common.fresh(docs, f"__{c}") for c in ("k", "z", "same", "at"))
    key = common.plain_key(F.col(id_col))
    found = join(docs, id_col, text, n, percent).where(F.col(id_col).isNotNull()).groupBy(id_col)
    gone = found.agg(F.min((F.col("component_id") < F.col(id_col)).cast("int")).alias("all")).where("all = 1")
    gone = gone.select(F.col(id_col).alias(k), F.lit(False).alias(z))
    rows = docs.withColumns({k: key["k"], z: key["z"], same: F.xxhash64(F.col(text), F.col(text).isNull())})
    rows = rows.join(gone, [k, z], "left_anti")
    first = rows.withColumn(at, F.row_number().over(Window.partitionBy(k, z, same).orderBy(F.lit(0))))
    return first.where(F.col(at) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS gram FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id),
links AS (
    SELECT a, b, i = p.n AND i = q.n AS same FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
copies AS (SELECT a, count(*) AS c FROM links WHERE same GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least.component_id, (coalesce(copies.c, 0) + 1)::BIGINT AS n_copies
FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN copies ON copies.a = d.doc_id
"""
