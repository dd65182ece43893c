"""Words and hashes of many texts at once, as numpy arrays over Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text worked on at once, but for a longer single text.
SLICE = 1 << 18
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_FORWARD, _BACKWARD = powers(_BASE, SLICE), powers(_INVERSE, SLICE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return (_FORWARD, _BACKWARD) if n <= SLICE else (powers(_BASE, n), powers(_INVERSE, n))


def texts(column, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, text offsets) of slices of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, the same wherever the range stands."""
    forward, backward = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * backward[np.minimum(starts, len(data) - 1)] if len(data) else sums[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """Words of a slice of texts: byte places, and the number of words before each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        word = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.before = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash per word, the same wherever the word stands."""
        return hashes(_LOWER[self.data] if lower else self.data, self.starts, self.ends)


def windows(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of each n consecutive values (len - n + 1 of them), before mixing.

    Powers of two are built by doubling, then joined: log n passes.
    """
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, have, out, taken = values.astype(np.uint64), 1, None, 0
    rest = n
    while rest:
        if rest & 1:
            part = power[taken : taken + count]
            out = part.copy() if out is None else out * np.uint64(pow(base, have, 1 << 64)) + part
            taken += have
        rest >>= 1
        if rest:
            power = power[:-have] * np.uint64(pow(base, have, 1 << 64)) + power[have:]
            have *= 2
    return out


def least_in_windows(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    if len(values) < n:
        return values[:0]
    have = 1
    while 2 * have <= n:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    return np.minimum(values[: len(values) - (n - have)], values[n - have :]) if n > have else values
