"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Among all document rates between 0 and
``most``, those that meet the target and stay closest in entropy to one copy of each
document are exponentially tilted by the document's size: rate / (most - rate) is
exp(tilt * size) / (most - 1). The tilts solve a convex dual problem, one dimension a source, by
Newton iterations; each is one distributed sum over the counts of (source, size).
Rates then become whole copies whose words come near the target.

All steps are DataFrame operations. The data that are iterated over are counts of
equal (source, size) pairs, so a source with a third of all documents is summed
before any shuffle; its documents are dealt to copies in hashed portions.

Results by case
    null or empty text: size 0, taken 0; null source: a source of its own, the last;
    no documents or no words: targets 0; one source: its target is 1.5 times its size;
    repeated rows: each is a document (which of them get one copy more is settled
    by their order under equal ids, and so may be any of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PORTIONS = 1024


def words_in(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size: one row a source) with a number ``s`` and its ``target``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share``
    times all words; a target stops at ``most`` times its source's size and the rest is
    shared again. The end of that is a level: target = min(most * size, level * weight),
    found from running sums over the sources in the order in which they stop."""
    # one row a source; this is the only place where they meet in one task
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("s", F.row_number().over(in_order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights)).cast("int") + 1)
    rows = numbered.withColumn("weight", weight).withColumn("stop", F.col("source_size") * most)
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "s")
    before, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("stop", "weight")]
    rows = rows.withColumn("words", F.sum("source_size").over(everything) * share).withColumn("all_weight", F.sum("weight").over(everything))
    rows = rows.withColumn("level", (F.col("words") - earlier[0]) / (F.col("all_weight") - earlier[1]))
    # the level belongs to the first source, in that order, that it doesn't stop
    fits = F.col("level") <= F.col("stop") / F.col("weight") * (1 + 1e-12)
    level = F.min(F.when(fits, F.struct(F.col("stop") / F.col("weight"), F.col("s"), F.col("level")))).over(everything)["level"]
    target = F.least("stop", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "s", "source_size", "target")


def _rate(tilt: Column, x: Column, most: float) -> Column:
    return F.lit(most) / (F.lit(1.0) + F.exp(-tilt * x) * (most - 1.0))


def tilts(counts: DataFrame, aims: DataFrame, most: float = 2.0, tolerance: float = 1e-6, steps: int = 60) -> DataFrame:
    """``aims`` (s, source_size, target) with ``unit`` and ``tilt``: the rate of a document of
    ``size`` words is tilted by tilt * size / unit. ``counts``: s, size, n.

    Newton iterations from 0 for every source at once; a step that leaves the interval
    known to hold the solution is replaced by the interval's middle (or by doubling). Tilts that
    ``steps`` iterations don't find are an error."""
    mean = counts.groupBy("s").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("unit"))
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * most * (1 - 1e-9))
    state = aims.where(open_).join(mean, "s").select(
        "s", "target", "unit", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")
    )
    state = common.durable(state)
    for _ in range(steps):
        x = F.col("size") / F.col("unit")
        rate = _rate(F.col("tilt"), x, most)
        weighted = F.col("n") * F.col("size") * rate
        sums = counts.join(state.select("s", "tilt", "unit"), "s").groupBy("s").agg(
            F.sum(weighted).alias("words"), F.sum(weighted * x * (1 - rate / most)).alias("slope")
        )
        now = state.join(sums, "s").withColumn("short", F.col("target") - F.col("words"))
        now = now.withColumn("low", F.when(F.col("short") > 0, F.col("tilt")).otherwise(F.col("low")))
        now = now.withColumn("high", F.when(F.col("short") <= 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") + F.col("short") / F.col("slope")
        inside = (F.coalesce(newton > F.col("low"), F.lit(True))) & (F.coalesce(newton < F.col("high"), F.lit(True)))
        middle = F.coalesce((F.col("low") + F.col("high")) / 2, F.col("tilt") * 2 + F.signum("short"))
        far = F.abs(newton - F.col("tilt")) > 4 + 2 * F.abs(F.col("tilt"))
        bounded = F.col("tilt") + F.signum("short") * (4 + F.abs(F.col("tilt")))
        step = F.when(inside & F.coalesce(~far, F.lit(False)), newton).when(
            F.col("low").isNull() | F.col("high").isNull(), bounded
        ).otherwise(middle)
        done = F.abs(F.col("short")) <= F.col("target") * tolerance
        now = now.withColumn("tilt", F.when(done, F.col("tilt")).otherwise(step)).withColumn("open", ~done)
        now = common.durable(now.select("s", "target", "unit", "tilt", "low", "high", "open"))
        state = now.drop("open")
        if not now.where("open").limit(1).count():
            break
    else:
        raise RuntimeError(f"tilts are not found after {steps} steps")
    return aims.join(state.select("s", "unit", "tilt"), "s", "left")


def _copies(classes: DataFrame, most: int) -> DataFrame:
    """s, size, n and ``total``: whole copies of all n documents of that size.

    Along the sizes from the largest, running sums of the rates are rounded; what is
    then left or over (half the largest size at most) is made up by copies from up to one
    size of each binary magnitude, largest first."""
    along = Window.partitionBy("s").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("n") * F.col("rate")).over(along)
    upto = classes.withColumn("upto", running)
    order = Window.partitionBy("s").orderBy(F.col("size").desc())
    rounded = F.floor(F.col("upto") + 0.5)
    first = upto.withColumn("total", rounded - F.coalesce(F.lag(rounded).over(order), F.lit(0)))
    first = first.withColumn("total", F.least(F.greatest("total", F.lit(0)), F.col("n") * most))
    left = first.groupBy("s").agg((F.max("target") - F.sum(F.col("total") * F.col("size"))).alias("left"))
    room = F.when(F.col("left") > 0, F.col("n") * most - F.col("total")).otherwise(F.col("total"))
    able = first.join(left, "s").withColumn("room", room).where((F.col("room") > 0) & (F.col("size") <= F.abs("left")))
    magnitude = F.floor(F.log2("size"))
    picks = able.groupBy("s", magnitude.alias("m")).agg(F.max(F.struct("size", "room", "left")).alias("p"))
    array = picks.groupBy("s").agg(F.sort_array(F.collect_list("p"), asc=False).alias("p"))
    step = lambda acc, p: F.struct(
        (acc["rest"] - p["size"] * F.least(p["room"], F.floor(acc["rest"] / p["size"]))).alias("rest"),
        F.concat(
            acc["flips"],
            F.array(F.struct(p["size"].alias("size"), F.least(p["room"], F.floor(acc["rest"] / p["size"])).alias("k"))),
        ).alias("flips"),
    )
    start = F.struct(
        F.abs(F.element_at("p", 1)["left"]).alias("rest"), F.array().cast("array<struct<size:bigint,k:bigint>>").alias("flips")
    )
    flips = array.select(
        "s", F.signum(F.element_at("p", 1)["left"]).cast("long").alias("sign"), F.explode(F.aggregate("p", start, step)["flips"]).alias("f")
    ).select("s", F.col("f.size").alias("size"), (F.col("sign") * F.col("f.k")).alias("k"))
    out = first.join(flips, ["s", "size"], "left")
    return out.select("s", "size", "n", "rate", (F.col("total") + F.coalesce("k", F.lit(0))).alias("total"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row a document: ``id_col``, size, source_size, target, rate, copies, taken."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"))
    sized = common.durable(rows)
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = common.durable(targets(by_source, weights, share, float(most)))
    named = aims.select("s", F.coalesce("source", F.lit("")).alias("k"), F.col("source").isNull().alias("z"))
    portion = F.pmod(F.xxhash64("id"), F.lit(PORTIONS)).alias("portion")
    sized = sized.withColumns({"k": F.coalesce("source", F.lit("")), "z": F.col("source").isNull()})
    dealt = common.durable(sized.join(named, ["k", "z"]).select("id", "s", "size", portion))

    counts = common.durable(dealt.where("size > 0").groupBy("s", "size").agg(F.count("*").alias("n")))
    solved = tilts(counts, aims.select("s", "source_size", "target"), float(most))
    rate = F.when(F.col("target") <= 0, 0.0).otherwise(
        F.coalesce(_rate(F.col("tilt"), F.col("size") / F.col("unit"), float(most)), F.lit(float(most)))
    )
    classes = counts.join(solved, "s").withColumn("rate", rate)
    classes = common.durable(_copies(classes, most))

    # a size's copies to its portions of documents, and a portion's to its documents
    portions = dealt.where("size > 0").groupBy("s", "size", "portion").agg(F.count("*").alias("here"))
    along = Window.partitionBy("s", "size").orderBy("portion").rowsBetween(Window.unboundedPreceding, 0)
    portions = portions.join(classes, ["s", "size"]).withColumn("upto", F.sum("here").over(along))
    through = lambda k: F.expr(f"({k} * total) div n")
    portions = portions.select(
        "s", "size", "portion", "rate", "here", (through("upto") - through("(upto - here)")).alias("total")
    )
    within = Window.partitionBy("s", "size", "portion").orderBy("id")
    copied = dealt.join(portions, ["s", "size", "portion"], "left").withColumn("rank", F.row_number().over(within))
    copies = F.expr("total div here + IF(rank <= total % here, 1, 0)")
    out = copied.withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long")).join(
        aims.select("s", "source_size", "target"), "s"
    )
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def take(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, with a new column ``copies`` (named apart if
    the name is taken). Rows equal in id and size share their copies."""
    mixed = mix(docs, id_col, text, source, **options)
    k, z, size, at, all_, rows_ = (common.fresh(docs, f"__{c}") for c in ("k", "z", "size", "at", "all", "rows"))
    copies, key = common.fresh(docs, "copies"), common.plain_key(F.col(id_col))
    counts = mixed.groupBy(key["k"].alias(k), key["z"].alias(z), F.col("size").alias(size)).agg(
        F.sum("copies").alias(all_), F.count("*").alias(rows_)
    )
    keyed = docs.withColumns({k: key["k"], z: key["z"], size: words_in(F.col(text))})
    rows = keyed.join(counts.where(F.col(all_) > 0), [k, z, size])
    rows = rows.withColumn(at, F.row_number().over(Window.partitionBy(k, z, size).orderBy(F.lit(0))))
    number = F.expr(f"{all_} div {rows_} + IF({at} <= {all_} % {rows_}, 1, 0)")
    return rows.withColumn(copies, number).where(F.col(copies) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], copies)
