"""Compact interval texts such as 30m, 6h or 1d."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvartal.functions import text as tx

DEFAULT_MINUTES = 360
MIN_MINUTES = 15
MAX_MINUTES = 7 * 24 * 60


def interval_minutes(text: Column | str) -> Column:
    """Minutes of an interval text; null when malformed or out of bounds."""
    shape = r"^\s*(\d+)\s*([mhd])\s*$"
    amount = tx.first_match(text, shape, 1).try_cast("bigint")
    unit = F.lower(tx.first_match(text, shape, 2))
    minutes = amount * F.when(unit == "m", 1).when(unit == "h", 60).otherwise(1440)
    return F.when(minutes.between(MIN_MINUTES, MAX_MINUTES), minutes)


def interval_text(minutes: Column | str) -> Column:
    m = tx.col(minutes)

    def whole(width: int, mark: str) -> Column:
        return F.concat((m / width).cast("bigint").cast("string"), F.lit(mark))

    return F.when(m % 1440 == 0, whole(1440, "d")).when(m % 60 == 0, whole(60, "h")).otherwise(
        whole(1, "m")
    )
