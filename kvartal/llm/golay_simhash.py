"""SimHash near-duplicates by Golay-code fuzzy hashing, components of confirmed links.

1. A text's fingerprint has a bit set where more than half of its three-word shingles have it
   set in their XXH64. Texts of one fingerprint are one class; only the class goes on.
2. A fingerprint is cut into segments of 22, 21 and 21 bits. The binary Golay code puts any
   23 bits within three errors of exactly one codeword, so a segment has an *own* codeword;
   with each of its bits turned it also has some *near* ones, six of them mostly. Segments
   that differ in one bit meet: the own codeword of either is an own or near one of the other.
3. At most three differing bits over three segments leave two segments with at most one
   each. Either each of the three segments has one, which the key (own, own) of the first two
   segments against all (near, near) finds; or a segment has none, and one of its
   pairs meets on (own, own) against (own, near) or (near, own). Both sides send all their keys,
   so every link shows under some key that is an own one of its other end.
4. Keys under which several fingerprints meet are confirmed by counting bits. A key of more
   than BLOCK members is dealt out as pairs of blocks; a task reports the spanning forest
   of a large group, not its pairs. Components join the confirmed links.

Defined results: a text without words, empty or null, has fingerprint zero and is linked like
any other; shorter texts than three words are one shingle; repeated rows are linked; a null
doc_id comes after others; an empty table gives an empty result. ``docs`` must be a stored
table, as ``apply`` knows rows by their number in the scan; only doc_id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.components import components
from kvartal.llm.shared import bounded_batches, numbered, row_id, written

WORDS = 3
#: Seed of the shingles' XXH64.
SEED = 42
#: Fingerprints are linked at this many differing bits at most; the keys are made for it.
ERRORS = 3
#: (lowest bit, width) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a key that one side of a comparison holds.
BLOCK = 2048
#: Groups up to this size are compared by shifting, all groups of a batch at once.
SMALL = 16
#: Shingles hashed before their bits are counted, and fingerprints given keys at once.
SLICE = 1 << 14
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _syndromes() -> np.ndarray:
    """Remainder modulo GENERATOR of each power of x below 23."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GENERATOR
    return np.array(out, dtype=np.uint32)


def _sums(parts: np.ndarray) -> np.ndarray:
    """XOR of every subset of ``parts``, by the subset's bits."""
    out = np.zeros(1, dtype=np.uint32)
    for p in parts:
        out = np.concatenate([out, out ^ p])
    return out


def _leaders() -> np.ndarray:
    """The error of at most three bits that each syndrome stands for."""
    remainders, bits = _syndromes(), range(23)
    out = np.zeros(1 << 11, dtype=np.uint32)
    for a in bits:
        for b in range(a, 23):
            for c in range(b, 23):
                places = {a, b, c}
                syndrome = 0
                for k in places:
                    syndrome ^= int(remainders[k])
                out[syndrome] = sum(1 << k for k in places)
    out[0] = 0
    return out


_LOW, _HIGH = _sums(_syndromes()[:12]), _sums(_syndromes()[12:])
_ERROR = _leaders()


def codeword(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword within three errors of each 23-bit number."""
    v = v.astype(np.uint32)
    return (v ^ _ERROR[_LOW[v & np.uint32(0xFFF)] ^ _HIGH[v >> np.uint32(12)]]) >> np.uint32(11)


def _near(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codewords of each segment with at most one bit turned: (row, codeword, is own)."""
    turned = np.concatenate([[0], 1 << np.arange(width)]).astype(np.uint32)
    found = codeword(segment.astype(np.uint32)[:, None] ^ turned[None])
    own = found[:, :1].copy()
    found.sort(axis=1)
    new = np.ones(found.shape, dtype=bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row = np.nonzero(new)[0]
    return row, found[new], (found == own)[new]


def _product(x, y, n: int):
    """Each codeword of one segment with each of another, row by row."""
    (rx, cx, ox), (ry, cy, oy) = x, y
    count = np.bincount(ry, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    times = count[rx]
    left = np.repeat(np.arange(len(rx)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + start[rx][left]
    return rx[left], cx[left], cy[right], ox[left], oy[right]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, own) of all keys of fingerprints. The pair of segments is part of a key."""
    near = [_near((prints >> np.uint64(low)) & np.uint64((1 << width) - 1), width) for low, width in SEGMENTS]
    rows, keys, owns = [], [], []
    for number, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        row, a, b, own_a, own_b = _product(near[i], near[j], len(prints))
        if number:  # one of the two segments is without errors
            some = own_a | own_b
            row, a, b, own_a, own_b = row[some], a[some], b[some], own_a[some], own_b[some]
        rows.append(row)
        keys.append((number << 24) | (a.astype(np.int64) << 12) | b.astype(np.int64))
        owns.append(own_a & own_b)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(owns)


def fingerprint(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    size = min(WORDS, len(words))
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), SLICE):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + SLICE], stops[k : k + SLICE], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        found = [fingerprint(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
        prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], names=["row", "doc_id", "print"])


def _keys(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        every = batch.column(0).to_numpy()
        for k in range(0, len(every), SLICE):
            prints = every[k : k + SLICE]
            row, key, own = keys_of(prints.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key), "print": pa.array(prints[row]), "own": pa.array(own)})


def _forest(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of a group: each member is reached once."""
    out, left = [], prints
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= ERRORS
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), at), found))
                queue.extend(found)
    return out


def links_of(group: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links inside groups, which are runs of equal numbers."""
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(group)))
    small = np.repeat(size <= SMALL, size)
    out = []
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        near = small[d:] & (np.repeat(start, size)[d:] == np.repeat(start, size)[:-d])
        near &= np.bitwise_count(prints[d:] ^ prints[:-d]) <= ERRORS
        at = np.flatnonzero(near)
        out.append((prints[at], prints[at + d]))
    for k in np.flatnonzero(size > SMALL).tolist():
        out += _forest(prints[start[k] : start[k] + size[k]])
    none = prints[:0]
    return np.concatenate([none, *(u for u, _ in out)]), np.concatenate([none, *(v for _, v in out)])


def _link(batches: Iterator) -> Iterator:
    """Links of rows sorted by (key, x, y); the last group of a batch waits for its rest."""
    import pyarrow as pa

    held = [np.zeros(0, np.int64)] * 4
    last = object()
    for batch in itertools.chain(batches, [last]):
        now = held if batch is last else [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        key, x, y, prints = now
        change = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        cut = len(key) if batch is last else int(change[-1]) if len(change) else 0
        held = [c[cut:] for c in now]
        group = np.zeros(cut, dtype=np.int64)
        group[change[change < cut]] = 1
        u, v = links_of(np.cumsum(group), prints[:cut].view(np.uint64))
        yield pa.RecordBatch.from_pydict({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})


def fingerprints(docs: DataFrame) -> DataFrame:
    """row, doc_id and print (64 bits as a long) of every document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(row_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_fingerprints, "row long, doc_id long, print long")


def links(prints: DataFrame) -> DataFrame:
    """(u, v) confirmed links that span the components of distinct fingerprints (column print)."""
    keys = written(prints.mapInArrow(_keys, "key long, print long, own boolean"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("size"), F.max("own").alias("met")).where("met AND size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    members = keys.join(sizes, "key").withColumn("blocks", blocks)
    members = members.withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    # a member goes to each pair of blocks that its own one is part of
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ("key", "x", "y")
    dealt = members.select(
        "key", F.least("block", "other").cast("bigint").alias("x"), F.greatest("block", "other").cast("bigint").alias("y"), "print"
    )
    dealt = dealt.repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(_link, "u long, v long").distinct()


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id, kept and row of every document.

    kept marks one row of each component: that of its smallest doc_id (of repeated rows
    with one doc_id, the first).
    """
    every = written(fingerprints(docs), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = written(every.groupBy("print").agg(first), "classes")
    found = components(written(links(classes.select("print")), "links"))
    named = classes.join(found, classes["print"] == found["node"], "left").select(
        "print", "first", F.coalesce("component", "print").alias("component")
    )
    named = written(named, "named")
    heads = named.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("head"))
    named = named.join(heads, F.col("component") == F.col("of")).select(F.col("print").alias("of"), "head")
    return every.join(named, F.col("print") == F.col("of")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
        (F.col("row") == F.col("head.row")).alias("kept"),
        "row",
    )


def apply(docs: DataFrame) -> DataFrame:
    """One document of each component, with its columns."""
    return numbered(docs).join(classify(docs).where("kept").select("row"), "row", "left_semi").select("doc.*")
