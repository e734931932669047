"""Row validation of untyped ingest: typing, good/bad split, error budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalake.functions.casts import Rule, cut_date, read_date
from taxalake.functions.once import select_once
from taxalake.operators.topk import top_n
from taxalake.sources.delimited import CORRUPT


def type_rows(raw: DataFrame, rules: list[Rule], keep=("rn",), date_formats=None) -> DataFrame:
    """Apply typing rules: the kept columns, the typed columns, ``_ok`` and
    ``_bad`` (names of the columns that failed, in rule order, joined by ``,``;
    ``_corrupt`` first for a short or long row of a quoted table).

    Plain boolean and string expressions only (no lambdas), so the whole
    step stays in generated code; each rule is evaluated once per row even
    when a filter on ``_ok`` follows.
    """
    dates = {r.name: r.source for r in rules if r.kind == "date" and date_formats is None}
    if dates:  # each text is cut once and read once
        own = [F.col(f"`{c}`") for c in raw.columns]
        raw = select_once(raw, *own, *[cut_date(F.col(c)).alias(f"_cut_{n}") for n, c in dates.items()])
        raw = select_once(raw, *own, *[read_date(F.col(c), cut=F.col(f"_cut_{n}")).alias(f"_read_{n}") for n, c in dates.items()])
    applied = [(r, *r.apply(date_formats, F.col(f"_read_{r.name}") if r.name in dates else None)) for r in rules]
    ok = F.lit(True)
    for _, _, o in applied:
        ok = ok & o
    reasons = [F.when(~o, F.lit(r.name)) for r, _, o in applied]
    if CORRUPT in raw.columns:  # rows whose number of fields is not the header's
        whole = F.col(CORRUPT).isNull()
        ok, reasons = ok & whole, [F.when(~whole, F.lit(CORRUPT)), *reasons]
    bad = F.concat_ws(",", *reasons)
    cols = [F.col(k) for k in keep] + [v.alias(r.name) for r, v, _ in applied]
    return select_once(raw, *cols, ok.alias("_ok"), bad.alias("_bad"))


def split_valid(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the flag columns, bad rows with ``_bad``)."""
    good = typed.where("_ok").drop("_ok", "_bad")
    bad = typed.where(~F.col("_ok")).drop("_ok")
    return good, bad


def error_cutoff(typed: DataFrame, order: str = "rn", budget: int = 50):
    """Order key of bad row ``budget + 1`` (a scalar subquery), or null when
    the budget holds. A top-k of ``budget + 1`` rows; no global sort or window."""
    bad = typed.where(~F.col("_ok")).select(order)
    cut = bad.orderBy(order).limit(budget + 1).agg(
        F.when(F.count(F.lit(1)) > budget, F.max(order)).alias("_cut")
    )
    return cut.scalar()


def apply_error_budget(
    typed: DataFrame, order: str = "rn", budget: int = 50, on_exceed: str = "keep"
) -> DataFrame:
    """Good rows of a dump with bad rows.

    ``'keep'``: every good row, whatever the number of bad ones (they are in
    ``bad_rows``). ``'fail'``: raise if more than ``budget`` rows are bad.
    ``'truncate'`` (the reference's reader): reading stops at bad row
    ``budget + 1`` and every later row is lost; only when asked for.
    """
    if on_exceed not in ("keep", "fail", "truncate"):
        raise ValueError(f"unknown on_exceed: {on_exceed}")
    good = typed.where("_ok")
    if on_exceed == "keep":
        return good.drop("_ok", "_bad")
    if on_exceed == "fail":
        n_bad = typed.where(~F.col("_ok")).count()
        if n_bad > budget:
            raise ValueError(f"{n_bad} bad rows exceed the error budget of {budget}")
        return good.drop("_ok", "_bad")
    cut = error_cutoff(typed, order, budget)
    return good.where(F.coalesce(F.col(order) < cut, F.lit(True))).drop("_ok", "_bad")


def reject_report(typed: DataFrame) -> DataFrame:
    """Bad rows per failing column (a row failing two columns counts twice)."""
    return (
        typed.where(~F.col("_ok"))
        .select(F.explode(F.split("_bad", ",")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    )


def bad_rows(typed: DataFrame, order: str = "rn") -> DataFrame:
    """Bad rows with their row number and failing columns joined by ``,``."""
    return typed.where(~F.col("_ok")).select(order, F.col("_bad").alias("reason"))


def row_slice(df: DataFrame, order: str, tail: int, head: int) -> DataFrame:
    """``tail -N | head -M``: the last ``tail`` rows by ``order``, then the
    first ``head`` of those. Two bounded top-n steps (``operators.topk``)."""
    return top_n(top_n(df, order, tail, ascending=False), order, head, ascending=True)
