"""Projections that the optimizer leaves in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Replace columns by expressions that are evaluated exactly once per row.

    Without this, filters on a cleaned column are pushed below the projection and
    every regular expression in it runs again for each mention. A one-element
    ``inline`` is a boundary the optimizer does not push through, and it stays inside
    whole-stage code generation.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    made = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
