"""Quality rules: base statistics, and lines that too many documents of a host repeat.

Each non-empty line is normalised (lower case, white space collapsed) and hashed. For
every (host, line) the distinct documents are counted; a line above the limit is
removed, and a document that keeps too small a share of its words is rejected.

Copies of one document are one document here: documents are told apart by a digest of
their whole set of lines. So a page that was crawled a thousand times isn't taken for
boilerplate (finding copies is the work of near-dedup), while a banner on a thousand
different pages is, however many lines these pages share.

Defined results: a null or empty text has no words and fails the base rules; a null host
is a host of its own; repeated rows are rows of their own with equal results; an empty
table gives an empty result. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.llm.shared import BLANK_CLASS, BLANKS, numbered, row_id, with_text, words_of, written

#: Distinct documents of one host that may hold a line.
MAX_DOCS = 30
#: Least share of words, in percent, that must be left after line removal.
MIN_LEFT = 30
MIN_WORDS = 50
MAX_REPEATED = 50
SYMBOLS = "[#*$%&|<>]"


def _line_hash(line: Column) -> Column:
    """64 bits of MD5 over the normalised line, as hexadecimal digits."""
    normal = F.lower(F.btrim(F.regexp_replace(line, f"{BLANK_CLASS}+", " "), F.lit(BLANKS)))
    return F.substring(F.md5(normal.cast("binary")), 1, 16)


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside three-word windows that the text holds twice or more.

    Equal window hashes meet by sorting (hash, place); the places found are sorted again
    and each adds the words that its successor doesn't cover. Each step is a column of its
    own: a lambda would otherwise compute the sorted array anew for each element.
    """
    rows = rows.withColumn(
        "windows",
        F.slice(
            F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
            F.lit(1),
            F.greatest(F.size("words") - 2, F.lit(0)),
        ),
    )
    rows = rows.withColumn(
        "placed",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twice = lambda x, j: F.when(
        (F.get("placed", j - 1)["h"] == x["h"]) | (F.get("placed", j + 1)["h"] == x["h"]), x["i"]
    )
    rows = rows.withColumn("places", F.sort_array(F.filter(F.transform("placed", twice), lambda i: i.isNotNull())))
    new = lambda i, j: F.least(F.lit(3), F.coalesce(F.get("places", j + 1) - i, F.lit(3)))
    added = F.aggregate(F.transform("places", new), F.lit(0), lambda total, n: total + n)
    return rows.withColumn("n_repeat_words", F.coalesce(added, F.lit(0)).cast("bigint")).drop(
        "windows", "placed", "places"
    )


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row per document: base statistics, its lines as (hash, words), and 128 bits of the set of lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        row_id().alias("row"),
        "doc_id",
        F.col(host).alias("host"),
        text.alias("text"),
        words_of(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), _has_word).alias("lines"),
    )
    base = with_repeated_words(base)
    base = base.select(
        "row",
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(
            "lines", lambda x: F.struct(_line_hash(x).alias("h"), F.size(words_of(x)).alias("n"))
        ).alias("lines"),
    )
    hashes = F.array_sort(F.array_distinct(F.transform("lines", lambda x: x["h"])))
    return base.withColumn("content", F.unhex(F.md5(F.array_join(hashes, "").cast("binary"))))


def frequent_lines(stats: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, h) of lines that more than ``max_docs`` distinct documents of the host hold.

    Both counts combine inside the map tasks first. A line of a third of all documents is
    dealt out by their digests, so its counts arrive as a few rows.
    """
    lines = stats.select("host", "content", F.explode("lines").alias("line")).select("host", "content", "line.h")
    each = lines.groupBy("host", "h", "content").agg(F.lit(1).alias("one"))
    return each.groupBy("host", "h").agg(F.count("one").alias("docs")).where(F.col("docs") > max_docs)


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT) -> DataFrame:
    """One row per document: row, statistics, base_failed, removed lines (hashes), kept."""
    stats = written(statistics(docs, host), "line-stats")
    hot = frequent_lines(stats, max_docs).select(F.col("host").alias("hot_host"), F.col("h").alias("hot_h"))
    lines = stats.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    found = lines.join(hot, F.col("host").eqNullSafe(F.col("hot_host")) & (F.col("h") == F.col("hot_h")))
    removed = (
        found.groupBy("row", "h")
        .agg(F.sum("n").alias("n"), F.count("n").alias("times"))
        .groupBy("row")
        .agg(
            F.sum("n").alias("removed_words"),
            F.sum("times").alias("removed_lines"),
            F.collect_list("h").alias("removed"),
        )
    )
    joined = stats.drop("lines", "content").join(removed, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return joined.select(
        "row",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * left >= min_left * F.col("n_words"))).alias("kept"),
        F.coalesce("removed_lines", F.lit(0)).cast("bigint").alias("n_removed_lines"),
        F.coalesce("removed_words", F.lit(0)).cast("bigint").alias("n_removed_words"),
        "removed",
    )


def apply(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left: int = MIN_LEFT) -> DataFrame:
    """The kept documents, with their columns, without the lines above the limit.

    ``n_chars``, where present, follows the new text. ``docs`` must be a stored table.
    """
    verdict = judge(docs, host, max_docs, min_left).where("kept").select("row", "removed")
    left = F.filter(
        F.split("doc.text", "\n"), lambda x: ~_has_word(x) | ~F.array_contains(F.col("removed"), _line_hash(x))
    )
    kept = numbered(docs).join(verdict, "row")
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(F.array_join(left, "\n"))
    return kept.select(with_text(docs, text, F.lit(True)).alias("doc")).select("doc.*")
