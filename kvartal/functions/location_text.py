"""Normal form of location texts and the aliases built from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.functions import text as tx

# Dashes that count as a hyphen, adjective endings, case endings.
DASHES = {0x2013: "-", 0x2014: "-", 0x2212: "-", 0x2011: "-"}
ADJECTIVE_ENDINGS = ("ский", "ская", "ское")
CITY_ENDINGS_1 = "еауыияю"
CITY_ENDINGS_2 = ("ом", "ем")
MIN_STEM = 4
WORD = r"\p{L}\p{N}_"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark has no function for."""
    return texts.str.normalize("NFKC").str.translate(DASHES).str.casefold()


def normal(text: Column | str) -> Column:
    folded = F.replace(_compose(tx.col(text)), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(folded, f"[^{WORD}-]+", " "))


def words(normal_text: Column | str) -> Column:
    return F.filter(F.split(tx.col(normal_text), "[ -]+"), lambda w: w != "")


def alias_variants(normal_alias: Column) -> Column:
    """The alias and, for an adjective, its stem of at least four letters."""
    ending = F.lit(False)
    for suffix in ADJECTIVE_ENDINGS:
        ending = ending | F.endswith(normal_alias, F.lit(suffix))
    stem = F.substring(normal_alias, F.lit(1), F.length(normal_alias) - 4)
    return F.array_compact(
        F.array(normal_alias, F.when(ending & (F.length(stem) >= MIN_STEM), stem))
    )


def city_word_forms(word: Column) -> Column:
    """The word and the word without a case ending."""
    n = F.length(word)
    one = F.lit(CITY_ENDINGS_1).contains(F.substring(word, -1, 1)) & (n > 1)
    two = F.substring(word, -2, 2).isin(*CITY_ENDINGS_2) & (n > 2)
    return F.array_compact(
        F.array(
            word,
            F.when(one, F.substring(word, F.lit(1), n - 1)),
            F.when(two, F.substring(word, F.lit(1), n - 2)),
        )
    )


def district_word_forms(word: Column) -> Column:
    """The word, and the word cut by up to four letters where an alias may be so short."""
    n = F.length(word)
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(4), n - MIN_STEM)))
    return F.transform(cuts, lambda k: F.substring(word, F.lit(1), n - k))


def _pattern(alias: Column, ending: Column | str) -> Column:
    body = F.regexp_replace(alias, " ", "[ -]+")
    tail = ending if isinstance(ending, Column) else F.lit(ending)
    return F.concat(F.lit(f"(?<![{WORD}])"), body, tail, F.lit(f"(?![{WORD}])"))


def city_pattern(alias: Column) -> Column:
    return _pattern(alias, f"(?:[{CITY_ENDINGS_1}]|{'|'.join(CITY_ENDINGS_2)})?")


def long_enough(alias: Column) -> Column:
    return F.length(F.replace(alias, F.lit(" "), F.lit(""))) >= MIN_STEM


def district_pattern(alias: Column) -> Column:
    return _pattern(alias, F.when(long_enough(alias), F.lit(f"[{WORD}]{{0,4}}")).otherwise(F.lit("")))
