"""Simple-8b: ids packed into 64-bit words, all steps vectorised over blocks.

The top four bits of a word are its selector: how many values of how many bits follow,
lowest first. Selector 0 is the escape: one value too wide for 60 bits, kept whole
in a list of exceptions, in order. Each block of BLOCK values begins a new word
(its last word may be padded with zeros), and the word offsets of blocks are stored,
so that any block can be decoded alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: (values, bits) by selector; fixed by the coding.
SELECTORS = (
    (1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
COUNTS = np.array([n for n, _ in SELECTORS], dtype=np.int64)
WIDTHS = np.array([b for _, b in SELECTORS], dtype=np.uint64)
_POWERS = np.array([1 << k for k in range(64)], dtype=np.uint64)
_BITS16 = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < 1 << 16:
        return _BITS16[values]
    return np.searchsorted(_POWERS, values, side="right").astype(np.uint8)


def _choices(bits: np.ndarray) -> np.ndarray:
    """For each place of each block (rows) the selector that takes most values from there."""
    rows, width = bits.shape
    wide = np.zeros((rows, width + 64), dtype=np.uint8)
    wide[:, :width] = bits
    choice = np.zeros((rows, width), dtype=np.uint8)
    top = {1: wide}  # maximum of the next 1, 2, 4 ... places
    for p in (2, 4, 8, 16, 32):
        half = top[p // 2]
        full = half.copy()
        full[:, : -(p // 2)] = np.maximum(half[:, : -(p // 2)], half[:, p // 2 :])
        top[p] = full
    for selector in range(len(SELECTORS) - 1, 0, -1):  # fewest values first, so more values overwrite
        n, b = SELECTORS[selector]
        p = 1 << (n.bit_length() - 1)
        most = np.maximum(top[p][:, :width], top[p][:, n - p : n - p + width])
        choice[most <= b] = selector
    return choice


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the blocks (one more than blocks), exceptions."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    blocks = -(-len(values) // BLOCK)
    padded = np.zeros(blocks * BLOCK + 64, dtype=np.uint64)
    padded[: len(values)] = values
    grid = _bits(padded[: blocks * BLOCK]).reshape(blocks, BLOCK)
    choice = _choices(grid)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, len(values))
    at = np.arange(blocks) * BLOCK
    flat, begun = choice.reshape(-1), []
    while len(at):  # all blocks go forward together, a word a step
        begun.append(at)
        at = at + COUNTS[flat[at]]
        open_ = at < ends
        at, ends = at[open_], ends[open_]
    starts = np.sort(np.concatenate(begun)) if begun else np.zeros(0, dtype=np.int64)
    used = flat[starts] if len(starts) else np.zeros(0, dtype=np.uint8)
    words = used.astype(np.uint64) << np.uint64(60)
    limit = (starts // BLOCK + 1) * BLOCK
    for selector in range(1, len(SELECTORS)):
        n, b = SELECTORS[selector]
        which = np.flatnonzero(used == selector)
        if len(which):
            at, over = starts[which], limit[which]
            made, cut = words[which], np.flatnonzero(at + n > over)
            for j in range(n):
                value = padded[at + j]
                value[cut[at[cut] + j >= over[cut]]] = 0
                made |= value << np.uint64(j * b)
            words[which] = made
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * BLOCK).astype(np.uint32)
    return words, offsets, padded[starts[used == 0]]


def decode(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    used = (words >> np.uint64(60)).astype(np.uint8)
    blocks = len(offsets) - 1
    counts = COUNTS[used]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    first = before[np.minimum(offsets[:-1], max(0, len(words) - 1))] if len(words) else before
    room = BLOCK + 64  # padding of a block's last word falls behind its values
    starts = before - first[block] + block * room
    out = np.zeros(blocks * room, dtype=np.uint64)
    out[starts[used == 0]] = exceptions
    for selector in range(1, len(SELECTORS)):
        k, b = SELECTORS[selector]
        which = np.flatnonzero(used == selector)
        if len(which):
            at, word = starts[which], words[which]
            for j in range(k):
                out[at + j] = word >> np.uint64(j * b) & np.uint64((1 << b) - 1)
    return out.reshape(blocks, room)[:, :BLOCK].reshape(-1)[:n]
