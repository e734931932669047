"""Evaluate costly expressions once per row.

When a filter sits above a projection, Catalyst pushes the filter down by
substituting the projected expressions into the predicate; a costly
expression (a JSON parse, a date parse) then runs once in the filter and
again in the projection. A generator is a barrier for that substitution:
columns produced by ``inline(array(struct(...)))`` are computed once, inside
the generator, and later filters read the computed values. The generator is
part of whole-stage code generation, so the barrier itself costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_once(df: DataFrame, *cols: Column) -> DataFrame:
    """``df.select(*cols)``, but each column is computed exactly once per row."""
    return df.select(F.inline(F.array(F.struct(*cols))))
