"""Merkle manifest of a dataset: a tree of hashes over its rows, and a proof for every row.

Rows are leaves. The leaves of a group, in their order, form a tree: every ``arity``
consecutive nodes have their hash as parent, until one node is left. The groups' roots, in
the groups' order, form a tree in the same way, whose root stands for the whole dataset.

Trees are built in blocks: a task takes the nodes that share an ancestor ``LEVELS`` above
and makes all levels between. A node keeps what its siblings add to its parent's hash (a
segment) and points to its parent. Proofs come from pointer jumping: a node whose
pointer ends ``d`` levels above takes over the pointer and the segment of the node there,
which reach ``d`` levels further, so that after log2(depth) self-joins every leaf reaches the
root. In a round only levels that are multiples of ``d`` take part; the others are on no leaf's
way any more. The node that many leaves point to is joined in copies, one for each
``2 ** SPREAD`` of the nodes below it, so no key is hot.

Results by case
    null group: a group of its own, before all others; groups in bytewise order;
    null id: before all numbered ones, never tampered with by ``op11_merkle``;
    equal ids: in the order of their leaves' hashes; repeated rows: each is a leaf;
    null fields: ``-`` in the leaf; other fields: byte count, ``:``, value;
    a lone leaf of a group is that group's root, a lone group's root the dataset's root;
    empty table: no rows; long texts are hashed whole; columns not named play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalake.operators.positions import numbered

from . import common

#: Levels of the tree that one task builds at once (blocks of arity ** LEVELS nodes).
LEVELS = 8
#: A join key stands for at most about 2 ** SPREAD rows.
SPREAD = 8
#: So many consecutive rows of a group are a key of the join that gives them their tree.
WIDE = 1 << 12


def field(c: Column) -> Column:
    """A field as it goes into a leaf."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _up(level: Column, arity: int) -> Column:
    """The parents of an array of nodes."""
    run = lambda i: F.array_join(F.slice(level, i * arity + 1, F.lit(arity)), "")
    last = F.floor((F.size(level) - 1) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(run(i), 256))


def _levels(nodes: DataFrame, base: int, arity: int, levels: int) -> DataFrame:
    """From nodes (t, i, h, depth) at level ``base``: t, block, depth and ``made``, for each block of
    nodes its levels from there up to ``levels`` above, or up to its tree's root."""
    block = arity**levels
    found = nodes.groupBy("t", F.expr(f"i div {block}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("i", "h"))).alias("own"), F.max("depth").alias("depth")
    )
    steps = F.least(F.lit(levels), F.col("depth") - base).cast("int")
    first = F.array(F.col("own.h"))
    more = F.aggregate(
        F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), first, lambda acc, _: F.concat(acc, F.array(_up(F.element_at(acc, -1), arity)))
    )
    return found.select("t", "block", "depth", F.when(steps <= 0, first).otherwise(more).alias("made"))


def _segments(made: DataFrame, base: int, arity: int, levels: int) -> DataFrame:
    """t, level, i, segment and depth of the nodes below a root (a lone leaf: an empty segment). A segment
    is what comes before and after the node in its parent's run, as ``before.after/``."""
    each = made.select("t", "block", "depth", F.posexplode("made").alias("k", "row")).where(
        (F.col("k") < levels) & ((F.col("k") + base < F.col("depth")) | (F.col("depth") == 0))
    )
    one = each.select("t", "block", "depth", "k", "row", F.posexplode("row").alias("j", "h"))
    run = (F.col("j") - F.col("j") % arity).cast("int")
    before = F.array_join(F.slice("row", run + 1, F.col("j") - run), "")
    after = F.array_join(F.slice("row", F.col("j") + 2, run + arity - F.col("j") - 1), "")
    width = F.element_at(F.lit([arity ** (levels - k) for k in range(levels)]).cast("array<long>"), F.col("k") + 1)
    return one.select(
        "t", (F.col("k") + base).alias("level"), (F.col("block") * width + F.col("j")).alias("i"),
        F.when(F.col("depth") == 0, F.lit("")).otherwise(F.concat(before, F.lit("."), after, F.lit("/"))).alias("segment"), "depth",
    )


def depth_of(n: Column, arity: int) -> Column:
    """Levels between the leaves and the root of a tree of ``n`` leaves."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= arity
    return F.size(F.filter(F.lit(powers).cast("array<long>"), lambda p: p < n))


def forest(leaves: DataFrame, arity: int = 2, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, int]:
    """Segments (t, level, i, segment, depth) of all nodes below the roots (and of lone leaves: empty
    ones), the roots (t, h) and the largest depth, of the trees ``t`` whose leaves (t, i from 0, h, depth
    of the tree) are given."""
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    nodes, segments, roots, base = leaves.select("t", F.col("i").cast("long").alias("i"), "h", "depth"), [], [], 0
    while not base or base < deepest:
        made = common.durable(_levels(nodes, base, arity, levels))
        segments.append(_segments(made, base, arity, levels))
        last = F.element_at("made", -1)[0].alias("h")
        roots.append(made.where(F.col("depth") <= base + levels).select("t", last))
        nodes = made.where(F.col("depth") > base + levels).select("t", F.col("block").alias("i"), last, "depth")
        base += levels
    return reduce(DataFrame.union, segments), common.durable(reduce(DataFrame.union, roots)), deepest


def jump(segments: DataFrame, deepest: int, arity: int = 2, spread: int = SPREAD) -> DataFrame:
    """t, i, segment (up to the root) and top of every leaf, by doubling the distance to the ancestor.
    ``segments`` has t, level, i, segment and top, which the nodes below take from those above."""
    now, d = segments, 1
    while d < deepest:
        now = common.durable(now)
        below = arity ** min(d, spread)
        left = now.where(F.col("level") % (2 * d) == 0).withColumn("part", F.expr(f"i div {below}"))
        right = now.where(F.col("level") % (2 * d) == d)
        copies = arity**d // below  # so many parts are below an ancestor at distance d
        if copies == 1:
            right = right.withColumn("part", F.col("i"))
        else:
            # as far as the level below has nodes
            most = left.groupBy("t", "level").agg(F.max("part").alias("most"))
            right = right.join(most.select("t", (F.col("level") + d).alias("level"), "most").hint("merge"), ["t", "level"])
            parts = F.sequence(F.col("i") * copies, F.least((F.col("i") + 1) * copies - 1, F.col("most")))
            right = right.withColumn("part", F.explode(parts))
        right = right.select("t", (F.col("level") - d).alias("level"), "part", F.col("segment").alias("further"), F.col("top").alias("end"))
        joined = left.join(right.hint("merge"), ["t", "level", "part"], "left")
        segment = F.concat("segment", F.coalesce("further", F.lit(""))).alias("segment")
        now = joined.select("t", "level", "i", segment, F.coalesce("top", "end").alias("top"))
        d *= 2
    return now.where("level = 0").select("t", "i", "segment", "top")


def fold(leaf: Column, segment: Column) -> Column:
    """The root that a leaf and its segments lead to."""
    steps = F.filter(F.split(segment, "/"), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(F.split_part(s, F.lit("."), F.lit(1)), acc, F.split_part(s, F.lit("."), F.lit(2))), 256))


def siblings(segment: Column) -> Column:
    """The siblings' hashes of a proof, one after another."""
    return F.translate(segment, "./", "")


def manifest(rows: DataFrame, group: str = "lang", order: tuple[str, ...] = ("doc_id", "leaf"), leaf: str = "leaf",
             arity: int = 2) -> tuple[DataFrame, str | None]:
    """``rows`` (with their leaves' hashes) with ``subroot`` of their group, ``root`` and ``segment``,
    their proof from leaf to root; and the root (null without rows)."""
    placed = numbered(rows, [F.col(c).asc_nulls_first() for c in (group, *order)], name="_at", first=0)
    groups = placed.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    groups = numbered(groups, [F.col("_group").asc_nulls_first()], name="t", first=0)
    # rows are dealt by number to their group's tree, so a large group is many keys
    parts = F.sequence(F.expr(f"_first div {WIDE}"), F.expr(f"(_first + _n - 1) div {WIDE}"))
    spread = groups.select("_group", "t", "_first", depth_of(F.col("_n"), arity).alias("depth"), F.explode(parts).alias("_part"))
    same = (F.expr(f"_at div {WIDE}") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group"))
    leaves = placed.join(spread.hint("merge"), same).withColumn("i", F.col("_at") - F.col("_first"))
    leaves = common.durable(leaves.drop("_group", "_part", "_at", "_first"))

    segments, subroots, deepest = forest(leaves.select("t", "i", F.col(leaf).alias("h"), "depth"), arity)
    depth = depth_of(F.lit(subroots.count()), arity).alias("depth")
    upper, root, upper_depth = forest(subroots.select(F.lit(0).alias("t"), F.col("t").alias("i"), "h", depth), arity)
    root = root.first()
    none = F.lit(None).cast("string").alias("top")
    above = jump(upper.withColumn("top", none), upper_depth, arity).select(F.col("i").alias("t"), F.col("segment").alias("above"))
    # the nodes under a group's root (at most ``arity`` a group) reach on to the dataset's root, and know the group's
    last = (F.col("level") == F.col("depth") - 1) | (F.col("depth") == 0)
    above = above.join(subroots.withColumnRenamed("h", "top"), "t")
    ends = segments.where(last).join(above.hint("merge"), "t")
    ends = ends.select("t", "level", "i", F.concat("segment", "above").alias("segment"), "top")
    proofs = jump(segments.where(~last).select("t", "level", "i", "segment", none).union(ends), deepest, arity)
    out = leaves.join(proofs.withColumnRenamed("top", "subroot").hint("merge"), ["t", "i"]).drop("t", "i", "depth")
    value = root["h"] if root else None
    return out.withColumn("root", F.lit(value).cast("string")), value


def tampered(doc_id: Column) -> Column:
    """The rows that the query tampers with: 7 divides the crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def prove(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document; the root
    is recomputed from the leaf as it is after tampering (``n_chars`` one more)."""
    fields = lambda n: digest(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))))
    n = F.col("n_chars")
    now = F.when(tampered(F.col("doc_id")), fields(n + 1))
    rows = docs.select("doc_id", F.col("lang").alias("_lang"), fields(n).alias("leaf"), now.alias("_now"))
    found, _ = manifest(common.stored(rows, "leaves"), group="_lang")  # texts are read once
    found = found.withColumn("folded_root", fold(F.coalesce("_now", "leaf"), F.col("segment")))
    proof = F.sha2(siblings(F.col("segment")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs: ``name`` (levels of the trees of ``leaves``: t, i, h, n) and ``name_up`` (every leaf's way up)."""
    return f"""
{name}(k, t, i, n, h) AS (
    SELECT 0, t, i, n, h FROM {leaves}
    UNION ALL
    SELECT k + 1, t, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, t, i // 2, n),
{name}_up(k, t, i, leaf, n, before, after) AS (
    SELECT 0, t, i, i, n, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM {leaves}
    UNION ALL
    SELECT p.k + 1, p.t, p.i // 2, p.leaf, (p.n + 1) // 2, list_append(p.before, CASE WHEN p.i % 2 = 1 THEN s.h ELSE '' END),
           list_append(p.after, CASE WHEN p.i % 2 = 0 THEN coalesce(s.h, '') ELSE '' END)
    FROM {name}_up p LEFT JOIN {name} s ON s.k = p.k AND s.t = p.t AND s.i = xor(p.i, 1) WHERE p.n > 1)"""


def crc32_sql(text: str) -> str:
    """SQL of the crc32 of a short ASCII text; needs the CTE ``crc_table`` in the FROM clause."""
    step = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda a, b: xor(a >> 8, crc_table.of[xor(a, b) & 255 + 1]))"
    return f"xor({step.format(text)}, 4294967295)".replace("xor(a, b) & 255 + 1", "(xor(a, b) & 255) + 1")


def crc_table_sql() -> str:
    step = "CAST(i AS BIGINT)"
    steps = ", ".join(
        f"s{k + 1} AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s{k})" for k in range(8)
    )
    return f"s0 AS (SELECT i, {step} AS v FROM range(256) r(i)), {steps}, crc_table AS (SELECT list(v ORDER BY i) AS of FROM s8)"


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf_sql(n: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"


ORACLE = f"""
WITH RECURSIVE {crc_table_sql()},
hashed AS (
    SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS other,
           doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS tampered
    FROM documents, crc_table),
leaves AS (
    SELECT *, leaf AS h, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
    FROM hashed),
{_tree_sql("low", "leaves")},
subroots AS (SELECT 0 AS t, t AS i, h, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree_sql("high", "subroots")},
ways AS (
    SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, CASE WHEN l.tampered THEN l.other ELSE l.leaf END AS now,
           list_concat(a.before, b.before) AS before, list_concat(a.after, b.after) AS after
    FROM leaves l JOIN low_up a ON a.t = l.t AND a.leaf = l.i AND a.n = 1 JOIN subroots s ON s.i = l.t
    JOIN high_up b ON b.leaf = l.t AND b.n = 1 JOIN high r ON r.n = 1),
folded AS (
    SELECT *, list_reduce(list_prepend(now, list_transform(range(1, len(before) + 1), lambda j: before[j] || '.' || after[j])),
                          lambda x, y: sha256(split_part(y, '.', 1) || x || split_part(y, '.', 2))) AS folded_root
    FROM ways)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(range(1, len(before) + 1), lambda j: before[j] || after[j]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
