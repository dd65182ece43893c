"""Text column helpers.

Java regular expressions are ASCII-minded unless told otherwise, so every
pattern that touches Cyrillic or a non-breaking space carries ``(?uU)``
(Unicode case folding and Unicode character classes).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "(?uU)"
ANYCASE = "(?iuU)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), EXACT + r"^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(col(c), EXACT + r"\s+", " ")


def plain_spaces(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("\u00a0"), F.lit(" "))


def first_match(c: Column | str, pattern: str, group: int = 1, flags: str = ANYCASE) -> Column:
    """First match of ``pattern`` or null (``regexp_extract`` alone gives '')."""
    return blank_to_null(F.regexp_extract(col(c), flags + pattern, group))


def all_matches(c: Column | str, pattern: str, group: int = 1, flags: str = ANYCASE) -> Column:
    return F.regexp_extract_all(col(c), F.lit(flags + pattern), F.lit(group))


def first_non_empty(*cols: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def contains_any(c: Column | str, markers: tuple[str, ...]) -> Column:
    """True when the text holds one of the literal markers (null text: false)."""
    out = F.lit(False)
    for marker in markers:
        out = out | F.coalesce(F.contains(col(c), F.lit(marker)), F.lit(False))
    return out


def digits_to_long(c: Column | str) -> Column:
    return blank_to_null(F.regexp_replace(col(c), r"[^0-9]", "")).try_cast("bigint")


def decimal_text(c: Column | str) -> Column:
    return F.replace(col(c), F.lit(","), F.lit(".")).try_cast("double")


def first_by(entries: Column, key: str) -> Column:
    """Keep the first struct per ``key`` of an array, in order."""
    keys = F.transform(entries, lambda x: x[key])
    return F.filter(entries, lambda x, i: F.array_position(keys, x[key]) == i + 1)


def as_list(c: Column | str) -> Column:
    """Empty array for null, so HOFs and membership tests stay two-valued."""
    return F.coalesce(col(c), F.array())
