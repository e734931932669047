"""Views against SQL and against plain Python."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from taxalake.llm import chat

ROWS = [
    (1, 0, "system", "be <|end|> nice"), (1, 1, "user", "hi é😀"), (1, 2, "assistant", "hello"), (1, 2, "assistant", "hello"),
    (1, 3, None, None), (1, None, "bob", "late"), (None, 0, "a", "x"), (2, 0, "system", "only"), (3, 5, "b", "tie"), (3, 5, "a", "tie"),
    (4, 511, "a", "end of a window"), (4, 512, "b", "next"), (4, 513, "a", "again"), (5, 0, "a", ""), (6, 0, "a", "long " * 40_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, part int")


def views(df):
    return [r.asDict() for r in chat.views(df).withColumn("spans", chat.span_text(F.col("spans"))).collect()]


def test_against_sql(spark):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    got = con.execute(chat.ORACLE)
    names = [d[0] for d in got.description]
    expected = sorted(str(sorted(zip(names, r))) for r in got.fetchall())
    assert sorted(str(sorted(r.items())) for r in views(frame(spark, ROWS))) == expected


def test_masks_cover_the_speakers_words(spark):
    rows = views(frame(spark, ROWS))
    for r in rows:
        spans = [tuple(map(int, s.split("-"))) for s in r["spans"].split(",")]
        assert len(spans) == r["n_own"] >= 1  # one part each here
        for a, b in spans:
            assert r["text"][a:b].endswith("<|end|>") and r["text"][:a].endswith("<|assistant|>") and r["text"][b] == "\n"
        outside = r["text"]
        assert outside.count("<|assistant|>") == r["n_own"] and outside.count("<|end|>") == r["n_turns"]
    of_one = {r["speaker"]: r for r in rows if r["conv_id"] == 1 and r["part"] == 0}
    assert set(of_one) == {"user", "assistant", "unknown", "bob"}
    assert of_one["user"]["text"].startswith("<|system|>be < |end|> nice<|end|>\n<|assistant|>hi é😀<|end|>\n<|user:assistant|>hello")
    assert {(r["part"], r["speaker"]) for r in rows if r["conv_id"] == 4} == {(0, "a"), (0, "b")}
    assert not [r for r in rows if r["conv_id"] == 2]


def test_empty_and_plan(spark):
    empty = frame(spark, ROWS).limit(0)
    assert chat.views(empty).count() == 0
    assert "Python" not in chat.views(frame(spark, ROWS).filter("turn >= 0"))._jdf.queryExecution().optimizedPlan().toString()


def test_whole_dialogue_for_a_silent_and_a_late_speaker(spark):
    rows = [(7, 0, "system", "be nice")] + [(7, t, "user" if t % 2 else "bob", f"turn {t}") for t in (1, 2, 511, 512)] + [(7, 513, "carol", "late")]
    got = views(frame(spark, rows))
    assert {(r["speaker"], r["part"]) for r in got} == {(s, 0) for s in ("user", "bob", "carol")}
    carol = next(r for r in got if r["speaker"] == "carol")
    assert carol["text"].startswith("<|system|>be nice<|end|>\n<|user:user|>turn 1") and carol["n_turns"] == 6 and carol["n_own"] == 1


def test_parts_make_up_the_view(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "eve", "only once")] + [(1, t, "ab"[t % 2], f"söme {t}") for t in range(2, 40)] + [(1, 39, "b", "söme 39")] * 2
    rows += [(None, 1, "a", "x"), (None, 2, "b", "y"), (None, 3, "b", "y")]
    df = frame(spark, rows)
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.views(df).collect()}
    cut = chat.views(df, size=4).collect()
    assert len(whole) == 5 and len(cut) == 3 * 11 + 2
    for key, r in whole.items():
        own = sorted((x for x in cut if (x["conv_id"], x["speaker"]) == key), key=lambda x: x["part"])
        assert "".join(x["text"] for x in own) == r["text"]
        assert [s for x in own for s in x["spans"]] == r["spans"]
        assert sum(x["n_turns"] for x in own) == r["n_turns"] and max(x["n_turns"] for x in own) <= 4
    assert whole[1, "eve"]["n_turns"] == 42  # equal utterances stay


def test_a_very_long_dialogue_is_many_rows(spark):
    df = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.lit("x").alias("text"))
    got = chat.views(df).agg(F.count("*").alias("rows"), F.max("n_turns").alias("most"), F.sum("n_own").alias("own"), F.max("part").alias("part")).first()
    assert tuple(got) == (2 * 196, 512, 100_000, 195)
