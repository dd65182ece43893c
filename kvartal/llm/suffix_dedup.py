"""Suffix-array dedup: bytes covered by LENGTH bytes that also start earlier.

In a bucket the suffixes of all strings are sorted by prefix doubling, to a depth of
LENGTH bytes. Inside a run of suffixes that agree to that depth, previous and next
smaller positions (position: document, then place) are sought on both sides in
suffix order; a suffix with either has an earlier match, so its longest previous
factor reaches LENGTH and its bytes go. The first occurrence has neither and stays.

Suffixes that agree for LENGTH bytes share a minimiser of K bytes and so a bucket; see
``repeats`` for the exchange, which lets suffixes without a partner stay at home.

Defined results: null and empty texts have no bytes; a null doc_id comes last; equal
doc_ids are ordered by row; an empty table gives an empty result. Only doc_id and text
are read; ``docs`` must be a stored table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kvartal.llm import repeats
from kvartal.llm.arrays import hashes, mix, windows

LENGTH, K = 100, 24
RESULT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_CHAIN, _FIRST, _SECOND = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3


def cut(data: np.ndarray, offsets: np.ndarray) -> repeats.Runs:
    valid = repeats.valid_windows(offsets, len(data), LENGTH)
    first, last, least, times = repeats.runs_of(valid, mix(windows(data, K, _CHAIN)), LENGTH - K + 1)
    text = np.searchsorted(offsets, first, side="right") - 1
    return repeats.Runs(text, first - offsets[text], first, last + LENGTH, least, times)


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), dtype=np.uint64)
    rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])).astype(np.uint64)
    return rank


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` bytes (at least eight), equal ones alike.

    Depths double from eight; the last step joins two overlapping halves. Near the end
    suffixes count as followed by zero bytes.
    """
    keys = np.zeros(len(data), dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    for j in range(8):
        keys = keys << np.uint64(8) | padded[j : j + len(data)]
    rank, depth = _ranks(keys), 8
    while depth < length:
        step = min(depth, length - depth)
        after = np.zeros(len(rank), dtype=np.uint64)
        after[: len(rank) - step] = rank[step:]
        rank, depth = _ranks(rank << np.uint64(32) | after), depth + step
    return rank


def smaller_before_and_after(run: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a smaller position stands before, and after, inside the same run.

    ``run`` never falls; ``position`` is distinct. Runs are set apart by a large step, so
    that one running minimum serves all of them.
    """
    step = np.int64(len(position) + 1)
    rank = np.empty(len(position), dtype=np.int64)
    rank[np.argsort(position)] = np.arange(len(position))
    down = rank - run * step
    before = np.minimum.accumulate(down) < down
    up = (rank + run * step)[::-1]
    after = (np.minimum.accumulate(up) < up)[::-1]
    return before, after


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def later_copies(data: np.ndarray, offsets: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Strings whose bytes an earlier string (by position) has as a whole; bytes are compared."""
    start, size = offsets[:-1], np.diff(offsets)
    value = hashes(data, start, offsets[1:])
    order = np.lexsort((position, value, size))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (size[order][1:] != size[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    maybe, like = order[~new], first[~new]
    out = np.zeros(len(size), dtype=bool)
    if len(maybe):
        same = data[_places(start[maybe], size[maybe])] == data[_places(start[like], size[like])]
        out[maybe] = np.logical_and.reduceat(same, np.cumsum(size[maybe]) - size[maybe])
    return out


def judge(group: repeats.Group) -> repeats.Verdict:
    # strings are ordered by (document, row, place); they are few, so they are ranked first
    by_row = np.lexsort((group.row, group.order))
    order, row = group.order[by_row], group.row[by_row]
    of_row = np.empty(len(by_row), dtype=np.int64)
    of_row[by_row] = np.cumsum(np.concatenate([[0], (order[1:] != order[:-1]) | (row[1:] != row[:-1])]))
    position = of_row << np.int64(40) | group.first
    copy = later_copies(group.data, group.offsets, position)  # all of their suffixes have earlier matches

    whole = np.flatnonzero(copy)
    windows_of = np.diff(group.offsets)[whole] - LENGTH + 1
    gone_string = np.repeat(whole, windows_of)
    gone_place = _places(np.zeros(len(whole), dtype=np.int64), windows_of)
    kept = np.flatnonzero(~copy)
    size = np.diff(group.offsets)[kept]
    data = group.data[_places(group.offsets[kept], size)]
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.flatnonzero(repeats.valid_windows(offsets, len(data), LENGTH))
    string = np.searchsorted(offsets, at, side="right") - 1
    place = at - offsets[string]
    rank = suffix_ranks(data, LENGTH)[at]
    suffixes = np.argsort(rank)
    run = np.cumsum(np.concatenate([[False], rank[suffixes][1:] != rank[suffixes][:-1]])).astype(np.int64)
    before, after = smaller_before_and_after(run, (position[kept][string] + place)[suffixes])
    earlier = np.zeros(len(at), dtype=bool)
    earlier[suffixes] = before | after
    sent = np.flatnonzero(~earlier & group.salted[kept][string])
    digest = np.zeros((0, 2), dtype=np.uint64)
    if len(sent):
        digest = np.stack([mix(windows(data, LENGTH, base))[at[sent]] for base in (_FIRST, _SECOND)], axis=1)
    n_whole = len(gone_place)
    return repeats.Verdict(
        np.concatenate([gone_string, kept[string]]),
        np.concatenate([gone_place, place]),
        np.concatenate([np.arange(n_whole), n_whole + np.flatnonzero(earlier)]),
        n_whole + sent,
        digest,
        np.zeros(len(sent), dtype=bool),
    )


def settle(number: np.ndarray, place: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Of equal windows, all but the first by (document, row, place)."""
    order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], number))
    return order[1:][number[order[1:]] == number[order[:-1]]]


def finish(documents, row: np.ndarray, first: np.ndarray, last: np.ndarray):
    import pyarrow as pa

    n, gone, spans, kept = [], [], [], []
    rows = documents.column("row").to_numpy()
    low, high = np.searchsorted(row, rows, "left").tolist(), np.searchsorted(row, rows, "right").tolist()
    for text, a, b in zip(documents.column("text"), low, high, strict=True):
        data = (text.as_py() or "").encode()
        n.append(len(data))
        if a < b:
            out = repeats.covered(len(data), first[a:b], last[a:b], LENGTH)
            gone.append(int(out.sum()))
            spans.append(int(out[0]) + int((out[1:] & ~out[:-1]).sum()))
            data = np.frombuffer(data, np.uint8)[~out].tobytes()
        else:
            gone.append(0)
            spans.append(0)
        kept.append(data)
    whole = {"n_bytes": n, "n_removed": gone, "n_spans": spans}
    return pa.table(
        {"row": documents.column("row"), "doc_id": documents.column("doc_id")}
        | {k: pa.array(v, pa.int64()) for k, v in whole.items()}
        | {"kept": pa.array(kept, pa.binary())}
    )


def dedup(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans and the kept bytes of every document."""
    return repeats.removed(docs, cut, judge, settle, finish, RESULT, 1 << 18)
