"""Trie of conversation prefixes by a splitter skeleton.

Every conversation is a path of turns; a node is a distinct sequence of first turns. Paths
are sorted and dealt over shards by ranges. A node's conversations are neighbours in that
order, so a node is either within one shard or on the common prefix of two neighbouring
shards' edge paths (the splitters). These prefixes are the skeleton: it is broadcast, every
shard finishes all its other nodes alone, in one walk over its sorted paths, and of skeleton
nodes it sends partial aggregates, which are summed. In a second walk a shard knows the
summed skeleton and so the parent of every node.

What a subtree adds up (leaves, bytes that sharing saves) is a sum over the conversations
in it: sorted, a conversation brings in the nodes below its longest common prefix with the
one before it, and shares those above.

A path is cut into segments of ``SEGMENT`` turns, so that no row grows with a conversation.
Segment s holds nodes of depth ``s * SEGMENT`` to ``(s + 1) * SEGMENT - 1``; the segments that
follow the same prefix (a hash of it) are a trie of their own. What a conversation saves in
later segments is added to its earlier ones first. A turn is the 128-bit hash of its role and
text; texts are never moved.

Results by case
    null conv_id: no conversation; its rows are left out;
    null role or text: empty; null turn: first;
    equal turns: in the order of role, then of the text's md5; equal rows: each is a turn;
    a conversation without turns after rebuilding: a member of the root, ends there;
    empty table: no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taxalake.operators.positions import numbered

from . import common
from .merkle import crc32_sql, crc_table_sql

SEGMENT = 256
#: About so many turns make a shard.
SHARD_TURNS = 200_000
#: Ends of skeleton nodes are sent in rows of so many ids.
CHUNK = 4096
#: Turns of one conversation that share a key of the join with its header.
WIDE = 1 << 12
FIRST = 8


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), key (the turn's hash) and size (UTF-8 bytes of its text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.md5(text).alias("said"),
        key.alias("key"), F.octet_length(text).cast("long").alias("size"),
    )
    rows = common.stored(rows, "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    return numbered(rows, order, by=["conv_id"], name="d").select("conv_id", "d", "key", "size")


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % 9


def base_of(conv: Column) -> Column:
    return conv - conv % 5


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv_id, d, key, size), and conv_id and n, their lengths."""
    conv = F.col("conv_id")
    own = common.durable(turns.groupBy("conv_id").agg(F.count("*").alias("own")))
    base = own.select(F.col("conv_id").alias("_base"), F.col("own").alias("lent"))
    h = head_length(conv)
    head = own.join(base.hint("merge"), base_of(conv) == F.col("_base"), "left")
    kept = F.least(h, F.coalesce("lent", F.lit(0)))
    head = common.durable(head.select("conv_id", "own", kept.alias("kept"), (kept + F.greatest(F.col("own") - h, F.lit(0))).alias("n")))
    # a base's first turns go to the (at most nine) conversations around it
    lent = turns.where((F.col("d") <= FIRST) & (conv % 5 == 0)).withColumn("to", F.explode(F.sequence(conv - 4, conv + 4)))
    lent = lent.where((base_of(F.col("to")) == conv) & (F.col("d") <= head_length(F.col("to"))))
    lent = lent.select(F.col("to").alias("conv_id"), "d", "key", "size").join(own.select("conv_id").hint("merge"), "conv_id", "left_semi")
    # a long conversation's turns are dealt by number, so it is many keys
    late = turns.where(F.col("d") > h).withColumn("part", F.expr(f"d div {WIDE}"))
    parts = head.select("conv_id", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"own div {WIDE}"))).alias("part"))
    late = late.join(parts.hint("merge"), ["conv_id", "part"]).select("conv_id", (F.col("d") - h + F.col("kept")).alias("d"), "key", "size")
    return lent.union(late), head.select("conv_id", "n")


def segments_of(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """c, s, p (hash of what stands before), keys, sizes (that of the turn before the segment first),
    last (whether the conversation ends here) and after (p of the next segment)."""
    at = F.expr(f"(d - 1) div {segment}")
    ends = lengths.select("conv_id", F.expr(f"n div {segment}").alias("s"), F.lit(True).alias("last"))
    one = turns.select("conv_id", at.alias("s"), F.struct("d", "key", "size").alias("turn"))
    rows = one.withColumn("last", F.lit(False)).unionByName(ends.withColumn("turn", F.lit(None).cast(one.schema["turn"].dataType)))
    rows = rows.groupBy(F.col("conv_id").alias("c"), "s").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.max("last").alias("last"))
    rows = rows.withColumn("own", F.md5(F.array_join(F.transform("turns.key", lambda k: F.hex(k)), "").cast("binary")))
    # a sum of the segments' hashes with their numbers stands for all that is before
    number = lambda seed: F.xxhash64(F.lit(seed), "own", "s").cast("decimal(38,0)")
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    place = lambda w: F.concat_ws("_", *(F.coalesce(F.sum(number(k)).over(w), F.lit(0)).cast("string") for k in (1, 2)))
    last_size = F.lag(F.try_element_at("turns.size", F.lit(-1))).over(Window.partitionBy("c").orderBy("s"))
    return rows.select(
        "c", "s", place(before).alias("p"), F.col("turns.key").alias("keys"),
        F.concat(F.array(F.coalesce(last_size, F.lit(0).cast("long"))), F.col("turns.size")).alias("sizes"), "last", place(upto).alias("after"),
    )


def _common(a: list, b: list) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class Edges:
    """The first and last path of every shard (s, p, keys); a bounded table, one row a shard."""

    def __init__(self, rows: list) -> None:
        self.ids = sorted(r["shard"] for r in rows)
        of = {r["shard"]: r for r in rows}
        path = lambda x: (x["s"], x["p"], [bytes(k) for k in x["keys"]])
        self.first = {k: path(of[k]["first"]) for k in self.ids}
        self.last = {k: path(of[k]["last"]) for k in self.ids}
        at = {k: i for i, k in enumerate(self.ids)}
        near = lambda k, step: self.ids[at[k] + step] if 0 <= at[k] + step < len(self.ids) else None
        self.before = {k: near(k, -1) for k in self.ids}
        self.behind = {k: near(k, 1) for k in self.ids}

    @staticmethod
    def shared(a, b) -> int:
        """The depth of the deepest node that two paths have in common (-1: none)."""
        return _common(a[2], b[2]) if a[:2] == b[:2] else -1


def _walk(rows: Iterator[tuple], shard: int, edges: Edges, segment: int):
    """Yields, in the order of a shard's paths: ("row", row, shared with the path before, leaf) for
    each, ("open", depth, path, spans) when a node begins and ("close", depth) when it ends."""
    first, last = edges.before[shard], edges.behind[shard]
    left = edges.shared(edges.last[first], edges.first[shard]) if first is not None else -1
    right = edges.shared(edges.last[shard], edges.first[last]) if last is not None else -1
    before, depth, held = None, -1, None
    end_path = edges.last[shard]

    def step(row, after):
        nonlocal before, depth
        path = row[:3]
        keys = path[2]
        lcp = left if before is None else Edges.shared(before, path)
        least = min(lcp, depth) if before is not None else -1
        while depth > least:
            yield ("close", depth)
            depth -= 1
        ahead = Edges.shared(path, after) if after is not None else (Edges.shared(path, edges.first[last]) if last is not None else -1)
        for d in range(depth + 1, min(len(keys), segment - 1) + 1):
            # on a splitter: shared with the shard before, or on the last path and shared with the shard behind
            spans = d <= left and d <= Edges.shared(edges.first[shard], path) or d <= right and d <= Edges.shared(end_path, path)
            yield ("open", d, path, spans)
        depth = min(len(keys), segment - 1)
        yield ("row", row, lcp, len(keys) > ahead)
        before = path

    for row in rows:
        if held is not None:
            yield from step(held, row[:3])
        held = row
    if held is not None:
        yield from step(held, None)
    while depth >= 0:
        yield ("close", depth)
        depth -= 1


def _name(s: int, p: str, keys: list, d: int) -> str:
    return f"{s}/{d}/{p}/{hashlib.md5(b''.join(keys[:d])).hexdigest()}"


class Node:
    __slots__ = ("at", "children", "count", "ends", "excess", "leaves", "least", "mark", "name", "nexts", "parent", "text")

    def __init__(self, at, parent, text, name) -> None:
        self.at, self.parent, self.text, self.name = at, parent, text, name
        self.count = self.children = self.leaves = self.excess = 0
        self.least, self.ends, self.mark, self.nexts = None, None, None, []


def _nodes(rows: Iterator[tuple], shard: int, edges: Edges, segment: int):
    """The nodes of a shard as they end, each with what its conversations here add up to, and chunks of the
    ends of skeleton nodes: (kind, node)."""
    stack: list[Node] = []
    for event in _walk(rows, shard, edges, segment):
        if event[0] == "open":
            _, d, (s, p, keys), spans = event
            node = Node((s, p, d), stack[-1] if stack else None, 0, _name(s, p, keys, d) if spans else None)
            stack.append(node)
        elif event[0] == "close":
            yield "node", stack.pop()
        else:
            _, (s, p, keys, c, sizes, last, after, extra, deeper), lcp, leaf = event
            total = np.cumsum(sizes).tolist()
            top = total[min(lcp, segment - 1)] if lcp >= 0 else 0
            leaves = int(leaf) if last else deeper
            for node in stack:
                d = node.at[2]
                node.count += 1
                node.least = c if node.least is None else min(node.least, c)
                node.leaves += leaves
                node.excess += extra + (top - (total[d - 1] if d else 0) if lcp >= d else 0)
                if len(keys) > d and lcp <= d:
                    node.children += 1
                    if d == segment - 1:
                        node.nexts.append(after)
            if last:
                node = stack[-1]
                if node.ends is None:
                    node.ends = [] if node.name else hashlib.sha256()
                if node.name:
                    node.ends.append(c)
                    if len(node.ends) == CHUNK:
                        yield "ends", node
                        node.ends = []
                else:
                    node.ends.update(b"%d" % c if node.mark is None else b",%d" % c)
                    node.mark = True


ROW = ["s", "p", "keys", "c", "sizes", "last", "after", "extra", "deeper"]


def _rows(it: Iterator[pa.RecordBatch], found: list) -> Iterator[tuple]:
    for batch in it:
        cols = batch.to_pydict()
        found.extend(cols["shard"][:1] if not found else [])
        yield from zip(*(cols[c] for c in ROW))


def _started(it: Iterator[pa.RecordBatch]):
    """The shard's number and its rows (none, if the partition is empty)."""
    found: list = []
    rows = _rows(it, found)
    head = next(rows, None)
    if head is None:
        return None, rows

    def all_rows():
        yield head
        yield from rows

    return found[0], all_rows()


def _partials(shards: DataFrame, edges: Edges, segment: int) -> DataFrame:
    """Partial aggregates of the skeleton's nodes, a row for each shard and node, and chunks of their ends."""

    def run(it):
        shard, rows = _started(it)
        if shard is None:
            return
        out, seq = [], 0
        for kind, node in _nodes(rows, shard, edges, segment):
            if node.name is None:
                continue
            s, p, d = node.at
            up = node.parent.name if node.parent else None
            sums = (0, 0, 0, 0, None) if kind == "ends" else (node.count, node.children, node.leaves, node.excess, node.least)
            out.append((node.name, up, s, p, d, *sums, node.ends or [], shard, seq, [] if kind == "ends" else node.nexts))
            seq += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    names = ["name", "up", "s", "p", "d", "n", "children", "leaves", "excess", "least", "ends", "shard", "seq", "nexts"]
    i64, text = pa.int64(), pa.string()
    types = [text, text, i64, text, i64, i64, i64, i64, i64, i64, pa.list_(i64), i64, i64, pa.list_(text)]
    return shards.mapInArrow(run, "name string, up string, s long, p string, d long, n long, children long, leaves long, excess long, least long, ends array<long>, shard long, seq long, nexts array<string>")


def _digests(chunks: DataFrame) -> DataFrame:
    """name and ends_sha256 of skeleton nodes, from chunks of ids that are read one after another."""

    def run(it):
        now, h, some = None, None, False
        for batch in it:
            out = []
            for name, ids in zip(batch.column("name").to_pylist(), batch.column("ends")):
                if name != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h, some = name, hashlib.sha256(), False
                ids = ids.values.to_numpy(zero_copy_only=False)
                if len(ids):
                    h.update((b"," if some else b"") + b",".join(b"%d" % c for c in ids))
                    some = True
            if out:
                yield pa.RecordBatch.from_pydict({"name": [x[0] for x in out], "ends_sha256": [x[1] for x in out]})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"name": [now], "ends_sha256": [h.hexdigest()]})

    ordered = chunks.select("name", "shard", "seq", "ends").repartition("name").sortWithinPartitions("name", "shard", "seq")
    return ordered.mapInArrow(run, "name string, ends_sha256 string")


OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, s long, p string, nexts array<string>"
NAMES = [x.split()[0] for x in OUT.split(", ")]
EMPTY = hashlib.sha256().hexdigest()


def _finish(shards: DataFrame, edges: Edges, least: dict[str, int], segment: int) -> DataFrame:
    """The nodes within a shard. ``least``: the smallest conversation of every skeleton node."""
    i64, text = pa.int64(), pa.string()
    types = [i64] * 7 + [text, i64, text, pa.list_(text)]

    def run(it):
        shard, rows = _started(it)
        if shard is None:
            return
        nodes = [node for kind, node in _nodes(rows, shard, edges, segment) if kind == "node" and node.name is None]
        for a in range(0, len(nodes), 10_000):
            out = []
            for node in nodes[a : a + 10_000]:
                s, p, d = node.at
                up = node.parent
                parent = None if up is None else up.least if up.name is None else least[up.name]
                sha = node.ends.hexdigest() if node.ends is not None else EMPTY
                out.append((node.least, s * segment + d, parent, node.count, node.children, node.leaves, node.excess, sha, s, p, node.nexts))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=NAMES)

    return shards.mapInArrow(run, OUT)


def _excess(shards: DataFrame, edges: Edges, segment: int) -> DataFrame:
    """c, s, saved (bytes of the segment's nodes that another conversation brings in) and leaf, of every row."""

    def run(it):
        shard, rows = _started(it)
        if shard is None:
            return
        out = []
        for event in _walk(rows, shard, edges, segment):
            if event[0] == "row":
                _, (s, p, keys, c, sizes, last, *_), lcp, leaf = event
                out.append((c, s, sum(sizes[: min(lcp, segment - 1) + 1]) if lcp >= 0 else 0, int(leaf and last)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["c", "s", "saved", "leaf"])

    return shards.mapInArrow(run, "c long, s long, saved long, leaf long")


def _sharded(rows: DataFrame, n_turns: int) -> tuple[DataFrame, Edges]:
    """The rows in ranges of (s, p, keys, c), sorted, and the ranges' edge paths."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // SHARD_TURNS))
    dealt = rows.repartitionByRange(n, "s", "p", "keys", "c").sortWithinPartitions("s", "p", "keys", "c")
    shards = common.durable(dealt.withColumn("shard", F.spark_partition_id().cast("long")))
    path = F.struct("s", "p", "keys")
    edges = shards.groupBy("shard").agg(F.min(path).alias("first"), F.max(path).alias("last")).collect()
    return shards, Edges(edges)


def build(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of conversations: ``turns`` (conv_id, d from 1, key, size) and ``lengths``
    (conv_id, n; a conversation without turns has 0)."""
    n_turns = int(lengths.agg(F.sum("n")).first()[0] or 0)
    rows = common.durable(segments_of(turns, lengths, segment))
    # what conversations save after their first segments, from the later ones backwards
    later = rows.where("s > 0").withColumns({"extra": F.lit(0).cast("long"), "deeper": F.lit(0).cast("long")})
    shards, edges = _sharded(later, n_turns)
    found = _excess(shards, edges, segment)
    found = found.union(found.select("c", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).distinct())
    behind = Window.partitionBy("c").orderBy("s").rowsBetween(1, Window.unboundedFollowing)
    found = found.select("c", "s", F.sum("saved").over(behind).alias("extra"), F.sum("leaf").over(behind).alias("deeper"))
    rows = rows.join(found.hint("merge"), ["c", "s"], "left").fillna(0, ["extra", "deeper"])

    shards, edges = _sharded(rows.select("s", "p", "keys", "c", "sizes", "last", "after", "extra", "deeper"), n_turns)
    parts = common.durable(_partials(shards, edges, segment))
    skeleton = parts.groupBy("name").agg(
        F.max("up").alias("up"), F.max("s").alias("s"), F.max("p").alias("p"), F.max("d").alias("d"),
        *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "excess")), F.min("least").alias("least"),
    )
    skeleton = common.durable(skeleton.join(_digests(parts).hint("merge"), "name"))
    # at most as many nodes as the shards' edge paths have turns
    least = {r["name"]: r["least"] for r in skeleton.select("name", "least").collect()}
    local = _finish(shards, edges, least, segment)
    above = skeleton.select(F.col("name").alias("up"), F.col("least").alias("parent_conv_id"))
    spanning = skeleton.join(above.hint("merge"), "up", "left").select(
        F.col("least").alias("conv_id"), (F.col("s") * segment + F.col("d")).alias("depth"), "parent_conv_id",
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("excess").alias("saved_tokens"), "ends_sha256", "s", "p", F.array().cast("array<string>").alias("nexts"),
    )
    nodes = common.durable(local.unionByName(spanning))
    # a segment's root finds its parent among the nodes that lead to it
    links = nodes.select("nexts", "s", F.col("conv_id").alias("up"))
    links = links.union(parts.select("name", "nexts", "s").where(F.size("nexts") > 0).join(above.withColumnRenamed("up", "name").hint("merge"), "name").select("nexts", "s", "parent_conv_id"))
    links = links.select(F.explode("nexts").alias("p"), (F.col("s") + 1).alias("s"), "up")
    nodes = nodes.withColumn("p", F.when(F.col("depth") == F.col("s") * segment, F.col("p")))
    nodes = nodes.join(links.hint("merge"), ["s", "p"], "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "up").alias("parent_conv_id"), *NAMES[3:8])


def trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    turns, lengths = rebuild(turns_of(conversations))
    return build(common.durable(turns), lengths, segment)


ORACLE = f"""
WITH {crc_table_sql()},
given AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS d,
           md5(strlen(role) || ':' || role || text) AS key, strlen(text) AS size
    FROM given),
lengths AS (
    SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h
    FROM turns, crc_table GROUP BY conv_id, crc_table.of),
heads AS (
    SELECT l.*, least(l.h, coalesce(b.own, 0)) AS kept FROM lengths l LEFT JOIN lengths b ON b.conv_id = l.base),
rebuilt AS (
    SELECT c.conv_id, t.d, t.key, t.size FROM heads c JOIN turns t ON t.conv_id = c.base AND t.d <= c.h
    UNION ALL
    SELECT c.conv_id, t.d - c.h + c.kept, t.key, t.size FROM heads c JOIN turns t ON t.conv_id = c.conv_id AND t.d > c.h),
paths AS (
    SELECT conv_id, d, size, string_agg(key, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM lengths),
ended AS (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS ends, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM paths),
nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(up) AS up, any_value(size) AS size,
           coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
    FROM ended GROUP BY path, d),
kids AS (SELECT up AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
below AS (
    SELECT v.path, sum((u.n - 1) * u.size) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
    FROM nodes u JOIN ended v ON v.conv_id = u.conv_id AND v.d <= u.d LEFT JOIN kids k ON k.path = u.path GROUP BY v.path)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ended) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.path = n.up LEFT JOIN kids k ON k.path = n.path JOIN below b ON b.path = n.path
"""
