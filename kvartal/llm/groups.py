"""Rows sorted by keys, streamed through a task a few whole groups at a time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np


def whole_groups(batches: Iterator, n_keys: int) -> Iterator[tuple]:
    """(table, starts) of whole groups: rows that agree in the first ``n_keys`` columns.

    Rows come sorted by these columns (whole numbers); the last group of a batch waits for
    its rest, so a task holds a batch and one group. ``starts`` has each group's first
    row and ends with the number of rows.
    """
    import pyarrow as pa

    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            if held is not None and held.num_rows:
                yield held, _starts(held, n_keys)
            return
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        starts = _starts(held, n_keys)
        if len(starts) > 2:
            yield held.slice(0, starts[-2]), starts[:-1]
            held = held.slice(starts[-2])


def _starts(table, n_keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in range(n_keys):
        key = table.column(k).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)
