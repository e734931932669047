"""Chat formatting: every participant's view of a dialogue.

For each speaker of a conversation the whole dialogue is written with that speaker as the
assistant and all others as named users; the spans to learn from (the mask) are the
assistant's words with their end mark. A view is put out in parts of ``PART`` turns: every speaker
has every part, spans count from the view's beginning, and only the first part has what was said
first. So a conversation with very many turns is many rows and is never gathered in one task.

Results by case
    null role: a speaker called ``unknown``; role ``system`` speaks but has no view of its own;
    null text: empty; null turn: after all numbered turns;
    null conv_id: one conversation; one in which only the system speaks: no row;
    equal turn numbers: in the order of role, then text; equal rows: each is said;
    a part in which the speaker is silent: a row without spans;
    marks in a text (``<|``) are broken by a space, so no text can end its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taxalake.operators.positions import numbered

PART = 512


def _head(role: Column, speaker: Column) -> Column:
    """What stands before a turn in a speaker's view (null: a mere listener's)."""
    named = F.concat(F.lit("<|user:"), role, F.lit("|>"))
    return F.when(role == "system", F.lit("<|system|>")).when(role.eqNullSafe(speaker), F.lit("<|assistant|>")).otherwise(named)


def views(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    size: int = PART,
) -> DataFrame:
    """A row for each conversation, speaker and part: conv_id, part, speaker, n_turns, n_own, text and
    spans (array of start and end, in code points of the view, end exclusive)."""
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turns = conversations.select(
        F.col(conv).alias("conv_id"),
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("-")).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        clean(F.coalesce(role, F.lit("unknown"))).alias("role"),
        F.concat(clean(F.coalesce(text, F.lit(""))), F.lit("<|end|>\n")).alias("body"),
    )
    turns = numbered(turns, [F.col("turn").asc_nulls_last(), "role", "body"], by=["key"], name="d", first=0)
    turns = turns.withColumn("part", F.expr(f"d div {size}"))

    # how long a part is in each view: as long as for a mere listener, but for the speaker's own heads
    listened = F.char_length(_head(F.col("role"), F.lit(None).cast("string")))
    said = turns.groupBy("key", "conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.char_length("body") + listened).alias("chars"))
    parts = said.groupBy("key", "part").agg(F.sum("chars").alias("chars"))
    last = parts.groupBy("key").agg(F.max("part").alias("last"))
    speakers = said.where("role <> 'system'").select("key", "conv_id", F.col("role").alias("speaker")).distinct().join(last.hint("merge"), "key")
    grid = speakers.select("key", "conv_id", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("part"))
    own = said.select("key", "part", F.col("role").alias("speaker"), "n")
    grid = grid.join(own.hint("merge"), ["key", "part", "speaker"], "left").join(parts.hint("merge"), ["key", "part"])
    own_head = F.char_length(_head(F.col("speaker"), F.col("speaker"))) - F.char_length(_head(F.col("speaker"), F.lit(None).cast("string")))
    long = F.col("chars") + F.coalesce("n", F.lit(0)) * own_head
    before = Window.partitionBy("key", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("key", "conv_id", "speaker", "part", F.coalesce(F.sum(long).over(before), F.lit(0).cast("long")).alias("first"))

    gathered = turns.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("d", "role", "body"))).alias("turns"))
    each = gathered.join(grid.hint("merge"), ["key", "part"])
    said = F.transform(
        "turns",
        lambda t: F.struct(
            _head(t["role"], F.col("speaker")).alias("head"), t["body"].alias("body"), (t["role"] == F.col("speaker")).alias("own")
        ),
    )
    each = each.withColumn("said", said)
    start = F.struct(F.col("first").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def span(acc, t):
        a = acc["at"] + F.char_length(t["head"])
        b = a + F.char_length(t["body"])
        # the line break after the end mark is not learned
        found = F.array(F.struct(a.alias("start"), (b - 1).alias("end")))
        return F.struct(b.alias("at"), F.when(t["own"], F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"))

    return each.select(
        "conv_id", "part", "speaker", F.size("turns").alias("n_turns"),
        F.size(F.filter("said", lambda t: t["own"])).alias("n_own"),
        F.array_join(F.transform("said", lambda t: F.concat(t["head"], t["body"])), "").alias("text"),
        F.aggregate("said", start, span)["spans"].alias("spans"),
    )


def span_text(spans: Column) -> Column:
    """The spans as text: start-end, comma separated."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")


ORACLE = f"""
WITH turns AS (
    SELECT conv_id, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, turn
    FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS d FROM turns),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
said AS (
    SELECT t.*, s.speaker, t.role = s.speaker AS own,
           CASE WHEN t.role = 'system' THEN '<|system|>' WHEN t.role = s.speaker THEN '<|assistant|>'
                ELSE '<|user:' || t.role || '|>' END AS head,
           t.text || '<|end|>' || chr(10) AS body
    FROM numbered t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY d) AS upto FROM said)
SELECT conv_id, d // {PART} AS part, speaker, CAST(count(*) AS INTEGER) AS n_turns, CAST(sum(own::INT) AS INTEGER) AS n_own,
       string_agg(head || body, '' ORDER BY d) AS text,
       coalesce(string_agg(CASE WHEN own THEN (upto - length(body))::BIGINT::VARCHAR || '-' || (upto - 1)::BIGINT::VARCHAR END, ','
                           ORDER BY d), '') AS spans
FROM placed GROUP BY conv_id, d // {PART}, speaker
"""
