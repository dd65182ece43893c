"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts (shares of kinds of characters, word lengths, repetition)
are computed where the texts are read. Trees are fitted on a bounded sample of
labelled rows: up to SAMPLE rows, those with the least hash of doc_id. The fitted
trees become flat arrays (feature, threshold, children, leaf value), which all rows of a
batch walk together, a level per step.

Defined results: null and empty texts have statistics of zero and a score; rows without
a doc_id can't be learned from but are scored; repeated rows get equal scores; without
any usable label every score is 0.5. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.llm.arrays import Words, mix, texts, windows
from kvartal.llm.shared import bounded_batches, free_name

#: Labelled rows that are learned from, at most.
SAMPLE = 20_000
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 80, 4, 0.15, 64, 20
STATISTICS = (
    "bytes", "words", "word_bytes", "long_words", "short_words", "upper", "upper_words", "digits", "marks", "symbols",
    "pipes", "exclaims", "other_bytes", "blanks", "lines", "line_words", "distinct_words", "same_as_before",
    "distinct_pairs", "distinct_triples", "distinct_lines", "most_frequent", "symbol_ends", "first_upper",
)


def _kind(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=np.float64)
    table[list(chars)] = 1
    return table


_LETTERS = bytes(range(65, 91))
_KINDS = np.stack(
    [
        _kind(_LETTERS), _kind(b"0123456789"), _kind(b".,;:?'\"-()"), _kind(b"#*$%&<>"), _kind(b"|"), _kind(b"!"),
        _kind(bytes(range(128, 256))), _kind(b" \t\n\r\x0b\x0c"), _kind(b"\n"),
    ]
)
_SYMBOL = _kind(b"#*$%&<>!|").astype(bool)
_UPPER = _kind(_LETTERS).astype(bool)


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, and how often its most frequent one occurs."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, doc[starts], np.diff(np.append(starts, len(values))))
    return np.bincount(doc[starts], minlength=n), most


def statistics(column) -> Iterator[np.ndarray]:
    """Rows of STATISTICS for slices of an Arrow column of texts."""
    for _, data, offsets in texts(column):
        n = len(offsets) - 1
        size = np.diff(offsets).astype(np.float64)
        words = Words(data, offsets)
        counts = np.diff(words.before).astype(np.float64)
        doc = np.repeat(np.arange(n), np.diff(words.before))
        total = np.zeros((len(_KINDS), n))
        for k, kind in enumerate(_KINDS):
            sums = np.concatenate([[0.0], np.cumsum(kind[data])])
            total[k] = sums[offsets[1:]] - sums[offsets[:-1]]
        upper, digits, marks, symbols, pipes, exclaims, other, blanks, newlines = total
        length = (words.ends - words.starts).astype(np.float64)
        hashes = words.hashes()
        per = lambda flags: np.bincount(doc, weights=flags, minlength=n)
        same = np.zeros(len(doc))
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        starts_upper = _UPPER[data[words.starts]] if len(doc) else same
        second = np.minimum(words.starts + 1, max(0, len(data) - 1))
        both_upper = starts_upper * (_UPPER[data[second]] & (length > 1)) if len(doc) else same
        distinct, most = _distinct(hashes, doc, n)
        grams = []
        for k in (2, 3):
            values = mix(windows(hashes, k, 0xA0761D6478BD642F))
            inside = doc[: len(values)] == doc[k - 1 :] if len(values) else np.zeros(0, dtype=bool)
            grams.append(_distinct(values[inside], doc[: len(values)][inside], n)[0] / np.maximum(counts - k + 1, 1))
        # a line's value: its words' hashes, chained by their sum, so equal lines have equal values
        breaks = np.cumsum(data == 10)
        line = breaks[words.starts] if len(doc) else doc
        first = np.ones(len(doc), dtype=bool)
        first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        begun = np.flatnonzero(first)
        chained = np.add.reduceat(hashes, begun) if len(begun) else hashes
        lines = np.bincount(doc[begun], minlength=n).astype(np.float64)
        distinct_lines = _distinct(chained, doc[begun], n)[0]
        some, w, b = np.maximum(lines, 1), np.maximum(counts, 1), np.maximum(size, 1)
        yield np.stack(
            [
                size, counts, per(length) / w, per(length > 12) / w, per(length < 4) / w, upper / b, per(both_upper) / w,
                digits / b, marks / b, symbols / b, pipes / b, exclaims / b, other / b, blanks / b, newlines, counts / some,
                distinct / w, per(same) / w, grams[0], grams[1], distinct_lines / some, most / w,
                per(_SYMBOL[data[words.ends - 1]].astype(float)) / w if len(doc) else per(same), per(starts_upper) / w,
            ],
            axis=1,
        )


@dataclass
class Forest:
    """Trees as flat arrays, a row per tree and a place per node; node k's children are 2k+1 and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosting on log loss: each level of a tree is chosen from one histogram of all its nodes."""
    n, m = x.shape
    nodes = 2 ** (DEPTH + 1) - 1
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    forest = Forest(
        np.zeros((trees, nodes), dtype=np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), float(np.log(rate / (1 - rate)))
    )
    if not n or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(m)], axis=1)
    margin = np.full(n, forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            at = node - first
            best, choice = np.zeros(width), np.full(width, -1)
            for k in range(m):
                cell = at * BINS + binned[:, k]
                g = np.cumsum(np.bincount(cell, slope, width * BINS).reshape(width, BINS), axis=1)
                h = np.cumsum(np.bincount(cell, bend, width * BINS).reshape(width, BINS), axis=1)
                c = np.cumsum(np.bincount(cell, minlength=width * BINS).reshape(width, BINS), axis=1)
                rest_g, rest_h, rest_c = g[:, -1:] - g, h[:, -1:] - h, c[:, -1:] - c
                gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(c < LEAST_ROWS) | (rest_c < LEAST_ROWS)] = 0
                gain[:, len(edges[k]) :] = 0
                cut = gain.argmax(axis=1)
                better = gain[np.arange(width), cut] > best + 1e-9
                best[better] = gain[np.arange(width), cut][better]
                choice[better] = k * BINS + cut[better]
            for j in np.flatnonzero(choice >= 0):
                k, cut = divmod(int(choice[j]), BINS)
                forest.feature[t, first + j], forest.threshold[t, first + j] = k, edges[k][cut]
            node = 2 * node + 1 + (x[np.arange(n), forest.feature[t, node]] > forest.threshold[t, node])
        last = node - (2**DEPTH - 1)
        g, h = np.bincount(last, slope, 2**DEPTH), np.bincount(last, bend, 2**DEPTH)
        forest.value[t, 2**DEPTH - 1 :] = -RATE * g / (h + 1)
        margin += forest.value[t, node]
    return forest


def held_out() -> Column:
    """A fifth of the rows, by doc_id, that labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _measured(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        x = np.concatenate([np.zeros((0, len(STATISTICS))), *statistics(batch.column(1))])
        yield pa.RecordBatch.from_pydict(
            {"label": batch.column(0), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float64()))}
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Trees from at most ``sample`` labelled documents outside the held-out fifth.

    A document with several labels counts for each; the sample's statistics (24 numbers a
    row) are what comes to the driver.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = usable.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    measured = rows.select("quality", "text").mapInArrow(_measured, "label int, x array<double>")
    found = measured.collect()
    x = np.array([r["x"] for r in found], dtype=np.float64).reshape(-1, len(STATISTICS))
    y = np.array([r["label"] for r in found], dtype=np.float64)
    order = np.lexsort((*x.T, y))  # tasks end in any order; the fit must not depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1; others pass through, but for one of this very name."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name.lower() != name.lower()), T.StructField(name, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]
    at = names.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = [forest.score(x) for x in statistics(batch.column(at))]
            flat = np.concatenate([np.zeros(0), *scores])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flat)], names=[*batch.schema.names, name])

    return docs.select(*names).mapInArrow(run, schema)


def apply(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    name = free_name(docs, "score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)
