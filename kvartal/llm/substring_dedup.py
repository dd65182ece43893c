"""Substring dedup: words in windows of LENGTH words that occur elsewhere in the corpus.

Super-k-mer partitioning: windows are cut into runs with the same minimiser of K
words, and each run travels as one packed string to its minimiser's bucket, where
windows are sorted (by 128 bits over their words) and equal ones counted. A window
whose words start anywhere else goes, in every place; windows are judged on the
input. See ``repeats`` for the exchange and for hot minimisers.

Defined results: null, empty and short texts have no window and lose nothing; equal
doc_ids and repeated rows are documents of their own; an empty table gives an empty
result. Only doc_id and text are read; ``docs`` must be a stored table.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm import repeats
from kvartal.llm.arrays import Words, mix, windows
from kvartal.llm.shared import numbered, with_text

LENGTH, K = 35, 6
RESULT = "row long, doc_id long, n_words long, n_removed long, kept binary"
_CHAIN, _FIRST, _SECOND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3


def cut(data: np.ndarray, offsets: np.ndarray) -> repeats.Runs:
    words = Words(data, offsets)
    valid = repeats.valid_windows(words.before, len(words.starts), LENGTH)
    first, last, least, times = repeats.runs_of(valid, mix(windows(words.hashes(), K, _CHAIN)), LENGTH - K + 1)
    text = np.searchsorted(words.before, first, side="right") - 1
    ends = words.ends[last + LENGTH - 1]
    return repeats.Runs(text, first - words.before[text], words.starts[first], ends, least, times)


def _digests(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(windows(hashes, LENGTH, _FIRST)), mix(windows(mix(hashes ^ np.uint64(_CHAIN)), LENGTH, _SECOND))


def judge(group: repeats.Group) -> repeats.Verdict:
    """Windows of the group that occur twice or more in it."""
    words = Words(group.data, group.offsets)
    at = np.flatnonzero(repeats.valid_windows(words.before, len(words.starts), LENGTH))
    a, b = (d[at] for d in _digests(words.hashes()))
    order = np.argsort(a)
    equal = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][equal]] = True
    one_each = ~again  # the first of each kind in sorted order
    again[order[:-1][equal]] = True
    string = np.searchsorted(words.before, at, side="right") - 1
    sent = np.flatnonzero(one_each & group.salted[string])
    return repeats.Verdict(string, at - words.before[string], np.flatnonzero(again), sent, np.stack([a[sent], b[sent]], axis=1), again[sent])


def settle(number: np.ndarray, place: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Of windows that stand for their like: those found more than once that haven't gone yet."""
    return np.flatnonzero((np.bincount(number)[number] > 1) & ~met) if len(number) else number


def finish(documents, row: np.ndarray, first: np.ndarray, last: np.ndarray):
    import pyarrow as pa

    n, gone, kept = [], [], []
    rows = documents.column("row").to_numpy()
    low, high = np.searchsorted(row, rows, "left").tolist(), np.searchsorted(row, rows, "right").tolist()
    for text, a, b in zip(documents.column("text"), low, high, strict=True):
        words = (text.as_py() or "").encode().split()  # of bytes, at ASCII white space only
        n.append(len(words))
        if a < b:
            out = repeats.covered(len(words), first[a:b], last[a:b], LENGTH)
            gone.append(int(out.sum()))
            words = itertools.compress(words, (~out).tolist())
        else:
            gone.append(0)
        kept.append(b" ".join(words))
    return pa.table(
        {
            "row": documents.column("row"),
            "doc_id": documents.column("doc_id"),
            "n_words": pa.array(n, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def dedup(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, n_removed and the kept words, joined by one space (UTF-8)."""
    return repeats.removed(docs, cut, judge, settle, finish, RESULT, 1 << 18)


def apply(docs: DataFrame) -> DataFrame:
    """The documents with their columns; a text that lost words is its kept words, others stay as they are.

    ``n_chars``, where present, follows the new text.
    """
    changed = dedup(docs).where("n_removed > 0").select("row", F.decode("kept", "UTF-8").alias("kept"))
    rows = numbered(docs).join(changed, "row", "left")
    return rows.select(with_text(docs, F.col("kept"), F.col("kept").isNotNull()).alias("doc")).select("doc.*")
