"""Windows that occur more than once in a corpus, by super-k-mers.

A window is a run of units (words or bytes) of one text. Consecutive windows with the
same minimiser (least hash of the k-mers inside) form a super-k-mer. Equal windows
have equal minimisers, so they meet in the bucket of that minimiser:

1. ``_asked``: each chunk of documents sends its distinct minimisers with counts.
2. ``_told``: minimisers that occur once in the corpus are dropped; the chunks hear of
   the others.
3. ``_packed``: a super-k-mer whose minimiser occurs again travels as one string.
4. ``match``: in a bucket, ``judge`` compares windows and finds those to remove.
5. Spans go back to the chunks, where ``finish`` applies them.

A minimiser with more super-k-mers than HOT is dealt out over salts. Each salted group,
judged alone, settles what it can see and sends one digest per distinct window on;
digests meet by value (``settled``), at most one per salt. So no task holds a hot group.

Texts are shuffled once, by chunk; the second use reads the same shuffle files. Rows are
known by their number, so ``docs`` must be a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.arrays import least_in_windows, mix, texts
from kvartal.llm.shared import bounded_batches, partitions, row_id

#: Rows of a chunk: 2 ** CHUNK.
CHUNK = 8
#: Super-k-mers of one group at most, on average over salts.
HOT = 1024
#: Bytes of packed strings that are compared at once, but for a longer group.
BUFFER = 1 << 19
SPANS = "chunk long, row long, first long, last long"


@dataclass
class Runs:
    """Super-k-mers of a slice of texts: text, first window, bytes from and to, minimiser, its places."""

    text: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    least: np.ndarray
    times: np.ndarray


@dataclass
class Group:
    """Packed strings to compare: whole groups, one after another."""

    data: np.ndarray
    offsets: np.ndarray
    row: np.ndarray
    order: np.ndarray  # of the documents: less is earlier
    first: np.ndarray
    salted: np.ndarray


@dataclass
class Verdict:
    """For each window of a group: its string, its place there, whether it goes.

    ``sent``: windows that stand for their like in other salts, with 128-bit digests and
    a mark for those that have met their like already.
    """

    string: np.ndarray
    place: np.ndarray
    gone: np.ndarray
    sent: np.ndarray
    digest: np.ndarray
    met: np.ndarray


def valid_windows(offsets: np.ndarray, n_units: int, length: int) -> np.ndarray:
    """Which windows lie inside one text; ``offsets``: units before each text."""
    n = n_units - length + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    over = np.zeros(n_units + 1, dtype=np.int64)
    inner = offsets[1:-1]
    np.add.at(over, np.maximum(inner - length + 1, 0), 1)
    np.add.at(over, inner, -1)
    return np.cumsum(over)[:n] == 0


def runs_of(valid: np.ndarray, k_mers: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Runs of valid windows of ``width`` k-mers with one minimiser: first window, last window,
    minimiser, and at how many places the run has it.

    The leftmost least k-mer is a window's minimiser (places ride in the low bits). Where
    a text repeats itself, windows with equal k-mers in several places stay one run.
    """
    low = np.uint64((1 << len(k_mers).bit_length()) - 1)
    least = least_in_windows(k_mers & ~low | np.arange(len(k_mers), dtype=np.uint64), width)
    change = np.ones(len(valid), dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    edges = np.flatnonzero(change)
    value, inside = k_mers[(least[edges] & low).astype(np.int64)], valid[edges]
    new = np.ones(len(edges), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | ~inside[1:] | ~inside[:-1]
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(edges)))
    first, last = edges[starts], np.append(edges[starts[1:]], len(valid))[: len(starts)] - 1
    kept = inside[starts]
    return first[kept], last[kept], value[starts][kept], times[kept]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Arrow binary array of ranges of ``data``."""
    import pyarrow as pa

    size = end - start
    ends = np.cumsum(size)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.zeros(len(size) + 1, dtype=np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[places])])


def chunked(docs: DataFrame) -> DataFrame:
    rows = docs.select(row_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.select(F.shiftright("row", CHUNK).alias("chunk"), "row", "doc_id", "text")


def removed(
    docs: DataFrame,
    cut: Callable[[np.ndarray, np.ndarray], Runs],
    judge: Callable[[Group], Verdict],
    settle: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
    finish: Callable,
    schema: str,
    most: int,
) -> DataFrame:
    """``finish``'s rows for every document, given the windows that ``judge`` removes.

    ``settle`` gets sent windows sorted by digest (group number, order, first, met) and
    tells which go. ``finish`` gets a chunk's documents and spans of windows by row.
    ``most``: bytes of text that ``cut`` gets at once.
    """
    bounded_batches(docs.sparkSession)
    rows = chunked(docs)
    n_buckets = 2 * partitions(docs.sparkSession)

    def asked(batches: Iterator) -> Iterator:
        now, held = None, []
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            for k, data, offsets in texts(batch.column(1), most):
                runs = cut(data, offsets)
                of = chunk[k + runs.text]
                for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else ():
                    if of[part[0]] != now:
                        yield from _bucketed(now, held, n_buckets)
                        now, held = of[part[0]], []
                    held.append((runs.least[part], runs.times[part]))
        yield from _bucketed(now, held, n_buckets)

    def packed(documents, told):
        import pyarrow as pa

        least = np.frombuffer(b"".join(told.column("least").to_pylist()), np.uint64)
        total = np.frombuffer(b"".join(told.column("total").to_pylist()), np.int64)
        by_value = np.argsort(least)
        least, total = least[by_value], total[by_value]
        row, doc = documents.column("row").to_numpy(), documents.column("doc_id").combine_chunks()
        out = []
        for k, data, offsets in texts(documents.column("text"), most) if len(least) else ():
            runs = cut(data, offsets)
            at = np.minimum(np.searchsorted(least, runs.least), len(least) - 1)
            which = np.flatnonzero(least[at] == runs.least)
            salts = -(-total[at[which]] // HOT)
            of = row[k + runs.text[which]]
            spread = mix(of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + runs.first[which].astype(np.uint64))
            salt = np.where(salts > 1, (spread % salts.astype(np.uint64)).astype(np.int32), -1).astype(np.int32)
            out.append(
                pa.table(
                    {
                        "least": pa.array(runs.least[which].view(np.int64)),
                        "salt": pa.array(salt),
                        "row": pa.array(of),
                        "doc_id": doc.take(pa.array(k + runs.text[which])),
                        "first": pa.array(runs.first[which].astype(np.int64)),
                        "packed": strings(data, runs.start[which], runs.end[which]),
                    }
                )
            )
        types = [("least", pa.int64()), ("salt", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("packed", pa.binary())]
        return pa.concat_tables(out) if out else pa.schema(types).empty_table()

    def match(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group in _groups(batches):
            verdict = judge(group)
            gone = verdict.gone
            yield pa.RecordBatch.from_pydict(_spans(group.row[verdict.string[gone]], group.first[verdict.string[gone]] + verdict.place[gone]))

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group in _groups(batches, salted=True):
            v = judge(group)
            digest, string = v.digest, v.string[v.sent]
            out = np.stack(
                [digest[:, 0], digest[:, 1], group.order[string].astype(np.uint64), group.row[string].astype(np.uint64),
                 (group.first[string] + v.place[v.sent]).astype(np.uint64), v.met.astype(np.uint64)], axis=1
            )
            bucket = (out[:, 0] % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            parts = [(int(bucket[order[a]]), out[order[a:b]].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([p for p, _ in parts], pa.int32()), "windows": pa.array([w for _, w in parts], pa.binary())})

    def settled(group):
        import pyarrow as pa

        w = np.frombuffer(b"".join(group.column("windows").to_pylist()), np.uint64).reshape(-1, 6)
        w = w[np.lexsort((w[:, 1], w[:, 0]))]
        number = np.cumsum(np.concatenate([[False], (w[1:, :2] != w[:-1, :2]).any(axis=1)]))
        signed = w.view(np.int64)
        gone = settle(number, signed[:, 2:5], w[:, 5] != 0)
        return pa.table(_spans(signed[gone, 3], signed[gone, 4]))

    def finished(documents, spans):
        row = spans.column("row").to_numpy()
        order = np.argsort(row, kind="stable")
        return finish(documents, row[order], spans.column("first").to_numpy()[order], spans.column("last").to_numpy()[order])

    by_chunk = rows.groupBy("chunk")
    told = (
        rows.select("chunk", "text")
        .mapInArrow(asked, "bucket int, chunk long, least binary, n binary")
        .groupBy("bucket")
        .applyInArrow(_told, "chunk long, least binary, total binary")
    )
    super_kmers = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        packed, "least long, salt int, row long, doc_id long, first long, packed binary"
    )
    dealt = super_kmers.repartition("least", "salt").sortWithinPartitions("least", "salt")
    here = dealt.mapInArrow(match, SPANS)
    elsewhere = dealt.mapInArrow(send, "bucket int, windows binary").groupBy("bucket").applyInArrow(settled, SPANS)
    spans = here.unionAll(elsewhere)
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(finished, schema)


def _bucketed(chunk, held: list[tuple[np.ndarray, np.ndarray]], n_buckets: int) -> Iterator:
    import pyarrow as pa

    if held:
        least, where = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([t for _, t in held]), minlength=len(least))
        bucket = (least % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        parts = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int32()),
                "chunk": pa.array([int(chunk)] * len(parts), pa.int64()),
                "least": pa.array([least[p].tobytes() for p in parts], pa.binary()),
                "n": pa.array([n[p].astype("<u4").tobytes() for p in parts], pa.binary()),
            }
        )


def _told(group):
    """Minimisers of a bucket that occur twice or more, for each chunk that has them."""
    import pyarrow as pa

    blobs = group.column("least").to_pylist()
    least = np.frombuffer(b"".join(blobs), np.uint64)
    n = np.frombuffer(b"".join(group.column("n").to_pylist()), "<u4")
    values, where = np.unique(least, return_inverse=True)
    total = np.bincount(where, weights=n, minlength=len(values)).astype(np.int64)[where]
    edges = np.cumsum([0, *(len(b) // 8 for b in blobs)]).tolist()
    chunks, out, totals = [], [], []
    for chunk, a, b in zip(group.column("chunk").to_pylist(), edges, edges[1:], strict=False):
        again = total[a:b] > 1
        if again.any():
            chunks.append(chunk)
            out.append(least[a:b][again].tobytes())
            totals.append(total[a:b][again].tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "least": pa.array(out, pa.binary()), "total": pa.array(totals, pa.binary())})


def _spans(row: np.ndarray, window: np.ndarray) -> dict:
    """Runs of consecutive windows of a row, as first and last."""
    import pyarrow as pa

    order = np.lexsort((window, row))
    row, window = row[order], window[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] > window[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(row))[: len(starts)] - 1
    return {
        "chunk": pa.array(row[starts] >> CHUNK, pa.int64()),
        "row": pa.array(row[starts], pa.int64()),
        "first": pa.array(window[starts], pa.int64()),
        "last": pa.array(window[ends], pa.int64()),
    }


def _groups(batches: Iterator, salted: bool = False) -> Iterator[Group]:
    """Whole groups of sorted rows, some BUFFER bytes at once; ``salted``: only dealt-out ones.

    A salted group always comes alone. What it removes and what it sends is decided in two
    passes, and must not depend on which other salts of its minimiser lie nearby.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    rest = None
    for batch in batches:
        if salted:
            batch = batch.filter(pa.array(batch.column(1).to_numpy() >= 0))
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        key, salt = table.column(0).to_numpy(), table.column(1).to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1])) + 1
        bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(table.column(5)).to_numpy())])
        before = bytes_before[change]
        alone = change[(salt[change] >= 0) | (salt[change - 1] >= 0)]
        start = 0
        while True:
            full = change[np.searchsorted(before, bytes_before[start] + BUFFER) :][:1]
            edge = alone[np.searchsorted(alone, start, side="right") :][:1]
            if not len(full) and not len(edge):
                break
            stop = int(min(*full, *edge) if len(full) and len(edge) else (full if len(full) else edge)[0])
            yield _group(table.slice(start, stop - start))
            start = stop
        rest = table.slice(start)
    if rest is not None and rest.num_rows:
        yield _group(rest)


def _group(table) -> Group:
    table = table.combine_chunks()
    (first, data, offsets), *more = texts(table.column(5), 1 << 62)
    assert not first and not more
    known = table.column(3).combine_chunks()
    order = np.where(known.is_null().to_numpy(zero_copy_only=False), np.int64(2**63 - 1), known.fill_null(0).to_numpy())
    return Group(data, offsets, table.column(2).to_numpy(), order, table.column(4).to_numpy(), table.column(1).to_numpy() >= 0)


def covered(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Which of n units lie in a window between first and last of any span."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + length, -1)
    return np.cumsum(edges)[:n] > 0
