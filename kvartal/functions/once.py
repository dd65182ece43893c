"""Columns that are worked out once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns behind a one-row generator.

    Catalyst merges neighbouring projections by pasting an expression into every
    place that refers to it. For long text expressions used in many later columns
    that multiplies the work and the plan, and a generator is not merged.
    """
    name = "__once"
    packed = F.struct(*[value.alias(n) for n, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    rows = df.select(*kept, F.explode(F.array(packed)).alias(name))
    return rows.select(*kept, f"{name}.*")
