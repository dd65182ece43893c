"""Joins and ordered look-backs that survive a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SPLIT = 500_000


def salted_join(
    big: DataFrame,
    probe: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    residual: Column | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Inner equi join in which every hot key of ``big`` is split.

    Key sizes are measured first. Only keys above ``rows_per_split`` are kept in
    the split table, so it has at most rows/rows_per_split rows. Rows of a hot
    key are spread by a hash of ``spread_by``; the probe rows of that key are
    repeated once per split. All other keys stay as they are, and no row is lost.
    """
    splits = (
        big.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > rows_per_split)
        .select(*keys, F.ceil(F.col("__n") / rows_per_split).cast("int").alias("__splits"))
    )
    one = F.coalesce(F.col("__splits"), F.lit(1))
    left = (
        big.join(splits, list(keys), "left")
        .withColumn("__salt", F.pmod(F.xxhash64(*spread_by), one).cast("int"))
        .drop("__splits")
    )
    right = (
        probe.join(splits, list(keys), "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), one - 1)))
        .drop("__splits")
    )
    on = [*keys, "__salt"]
    joined = left.join(right, on, "inner")
    if residual is not None:
        joined = joined.where(residual)
    return joined.drop("__salt")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    chunk: Column,
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null value so far within a key, for keys of any size.

    ``chunk`` must rise with ``order`` (a day, an hour). The look-back runs inside
    (key, chunk) and over one summary row per chunk, so the events of a hot key
    are worked on chunk by chunk in many tasks instead of in one window.
    """
    df = df.withColumn("__chunk", chunk)
    end = 0 if inclusive else -1
    inner = (
        Window.partitionBy(*keys, "__chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, end)
    )
    raw = {f"__raw_{name}": value for name, value in values.items()}
    df = df.withColumns(raw)
    own = df.withColumns(
        {f"__own_{name}": F.last(f"__raw_{name}", ignorenulls=True).over(inner) for name in values}
    )
    rank = F.struct(*order)
    summary = df.groupBy(*keys, "__chunk").agg(
        *[
            F.max_by(
                F.col(f"__raw_{name}"), F.when(F.col(f"__raw_{name}").isNotNull(), rank)
            ).alias(f"__end_{name}")
            for name in values
        ]
    )
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("__chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = summary.select(
        *keys,
        "__chunk",
        *[
            F.last(f"__end_{name}", ignorenulls=True).over(earlier).alias(f"__in_{name}")
            for name in values
        ],
    )
    out = own.join(carried, [*keys, "__chunk"], "inner")
    out = out.withColumns(
        {name: F.coalesce(F.col(f"__own_{name}"), F.col(f"__in_{name}")) for name in values}
    )
    helper = [c for c in out.columns if c.startswith(("__raw_", "__own_", "__in_"))]
    return out.drop("__chunk", *helper)
