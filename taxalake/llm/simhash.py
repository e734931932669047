"""Document fingerprints: SimHash with permuted block tables.

Each word of a text is hashed to 64 bits and votes, with its length as weight, for or
against every bit of the fingerprint. The votes are summed as 32 packed counters (two
bits' votes in one long), so a text is one group of a plain aggregate.

Near fingerprints (within a Hamming radius) are found from tables: the bits are cut into
blocks, and for every choice of ``blocks - radius`` of them one table is keyed by those
blocks. Two fingerprints within the radius differ in at most ``radius`` blocks, so they
meet in at least one table; each pair is checked in the first table in which it meets.

Everything is DataFrame operations.

Results by case
    null text counts as empty; without a word, the fingerprint is 16 zeros;
    words are compared without regard to the case of letters; a repeated word votes again;
    one document: it is its own next document; null doc_id: after all others;
    several rows of one doc_id: each has a result; as a next document they are
    represented by the row whose text has the greatest xxhash64.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BITS = 64
_PAIR = (1 << 32) | 1


def _votes() -> list[Column]:
    """Sums over words ``__hash`` of weight ``__weight``: the weights for bit i and, 32 bits higher, for bit i + 32."""
    return [F.sum(F.shiftrightunsigned("__hash", i).bitwiseAND(F.lit(_PAIR)) * F.col("__weight")).alias(f"__v{i}") for i in range(32)]


def _decided() -> Column:
    """The fingerprint: bits whose votes in favour exceed half of all weights."""
    whole, low = F.col("__weight"), F.lit((1 << 32) - 1)
    bits = []
    for i in range(32):
        yes = F.col(f"__v{i}")
        for bit, votes in ((i, yes.bitwiseAND(low)), (i + 32, F.shiftrightunsigned(yes, 32))):
            one = F.shiftleft(F.lit(1).cast("long"), bit)
            bits.append(F.when(votes * 2 > whole, one).otherwise(F.lit(0).cast("long")))
    return reduce(Column.bitwiseOR, bits)


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` (long) for each row; ``keys`` must tell the rows apart."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"))
    words = rows.select(*keys, word.alias("__word"))
    votes = words.select(*keys, F.xxhash64("__word").alias("__hash"), F.char_length("__word").cast("long").alias("__weight"))
    return votes.groupBy(*keys).agg(F.sum("__weight").alias("__weight"), *_votes()).select(*keys, _decided().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def _masks(radius: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks that a table is keyed by."""
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    return [sum(c) - (1 << BITS if sum(c) >= 1 << (BITS - 1) else 0) for c in combinations(block, blocks - radius)]


def near(queries: DataFrame, points: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs ``query``, ``point`` of distinct fingerprints (long columns ``fingerprint``)
    within ``radius``, themselves included."""
    masks = _masks(radius, blocks)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))
    spread = lambda df, name: df.select("fingerprint").distinct().select(F.col("fingerprint").alias(name), table.alias("at")).select(name, "at.*")
    apart = F.col("query").bitwiseXOR(F.col("point"))
    first = F.lit(len(masks))
    for i, m in reversed(list(enumerate(masks))):
        first = F.when(apart.bitwiseAND(F.lit(m)) == 0, i).otherwise(first)
    q, p = spread(queries, "query").alias("q"), spread(points, "point").alias("p")
    meets = (F.col("q.t") == F.col("p.t")) & (F.col("q.k") == F.col("p.k"))
    return q.join(p, meets & (F.bit_count(apart) <= radius) & (first == F.col("q.t"))).select("query", "point")


def next_ids(ids: DataFrame) -> DataFrame:
    """``id`` and ``next_id`` for distinct ids, descending, null last, the last followed by the first.

    The ids are dealt in ranges; each range is put in order by itself, and the ranges'
    first ids (one row a range) link one range to the next."""
    desc = F.col("id").desc_nulls_last()
    ranged = common.durable(ids.distinct().repartitionByRange(desc).withColumn("part", F.spark_partition_id()))
    after = F.lead(F.struct("id")).over(Window.partitionBy("part").orderBy(desc))
    heads = ranged.groupBy("part").agg(F.max("id").alias("head"))
    in_order = Window.orderBy("part")
    first = F.first(F.struct("head")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead(F.struct("head")).over(in_order), first).alias("head"))
    return ranged.withColumn("after", after).join(heads, "part").select(
        "id", F.when(F.col("after").isNull(), F.col("head.head")).otherwise(F.col("after.id")).alias("next_id")
    )


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's text with its last floor(n / 2) code points replaced by the first as
    many of the next document: id, next_id, row (tells equal ids apart), n_chars, text, edited."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    lengths = rows.groupBy("id").agg(F.max(F.char_length("text")).alias("n"))
    link = next_ids(lengths.select("id")).alias("l")
    sizes = lengths.withColumns(common.plain_key(F.col("id"))).select("k", "z", "n")
    wanted = link.withColumns(common.plain_key(F.col("id"))).join(sizes, ["k", "z"])
    wanted = common.durable(wanted.select(
        F.col("k").alias("for_k"), F.col("z").alias("for_z"), "next_id", *[c.alias(n) for n, c in common.plain_key(F.col("next_id")).items()],
        (F.col("n") / 2).cast("int").alias("need"),
    ))
    keyed = rows.withColumns(common.plain_key(F.col("id"))).select("k", "z", "text")
    given = keyed.join(wanted, ["k", "z"]).select(
        F.col("for_k").alias("k"), F.col("for_z").alias("z"), "next_id",
        F.struct(F.xxhash64("text").alias("h"), F.col("text").substr(F.lit(1), F.col("need")).alias("start")).alias("g"),
    )
    given = given.groupBy("k", "z").agg(F.max("next_id").alias("next_id"), F.max("g").alias("g"))
    n = F.char_length("text")
    half = (n / 2).cast("int")
    return (
        keyed.join(given, ["k", "z"])
        .withColumn("row", F.monotonically_increasing_id())
        .select(
            "k", "z", "next_id", "row", n.cast("long").alias("n_chars"), "text",
            F.concat(F.col("text").substr(F.lit(1), n - half), F.col("g.start").substr(F.lit(1), half)).alias("edited"),
        )
    )


def compare(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 3, blocks: int = 5, every: int = 50) -> DataFrame:
    """``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and for the
    ids divisible by ``every`` n_near: the number of other rows with a fingerprint within ``radius``."""
    pairs = edited_pairs(docs, id_col, text)
    keys = ["k", "z", "next_id", "row", "n_chars", "sha", "h"]
    both = pairs.select(
        *keys[:5], F.sha2("edited", 256).alias("sha"), F.xxhash64("text").alias("h"),
        F.explode(F.array(F.struct(F.lit(False).alias("new"), F.col("text").alias("text")),
                          F.struct(F.lit(True).alias("new"), F.col("edited").alias("text")))).alias("v"),
    ).select(*keys, "v.new", "v.text")
    marked = fingerprints(both, [*keys, "new"])
    found = marked.groupBy(*keys).agg(
        F.max(F.when(~F.col("new"), F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("new"), F.col("fingerprint"))).alias("edited"),
    )
    found = common.durable(found)

    face = found.groupBy("k", "z").agg(F.max_by("fingerprint", "h").alias("next"))
    face = face.select(F.col("k").alias("nk"), F.col("z").alias("nz"), "next")
    new = {f"n{n}": c for n, c in common.plain_key(F.col("next_id")).items()}
    out = found.withColumns(new).join(face, ["nk", "nz"])

    counts = found.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = found.where(~F.col("z") & (F.col("k") % every == 0)).select("fingerprint")
    close = near(asked, counts, radius, blocks).join(counts, F.col("point") == F.col("fingerprint"))
    close = close.groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    asks = F.when(~F.col("z") & (F.col("k") % every == 0), F.col("fingerprint"))
    out = out.withColumn("asks", asks).join(close, F.col("asks") == F.col("query"), "left")
    return out.select(
        F.when(~F.col("z"), F.col("k")).alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"), "n_near",
    )
