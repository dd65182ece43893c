"""Byte-level BPE by a global shuffle of distinct words, and decoding.

1. Texts are cut into chunks; the matches of the pattern in a chunk (pre-tokens) become
   numbers of its distinct words, the places of the words staying with the chunk.
2. Distinct words of all chunks go to buckets by hash, where each word is encoded
   once, however many chunks and documents hold it.
3. The ids go back to the chunks that asked for them; texts are put together by place.

Words travel in packed byte strings, a row per (chunk, bucket), so a word of every
document costs a few bytes per chunk, and no row or group grows with its frequency.
Decoding joins the table of token bytes, which is as large as the vocabulary.

``docs`` must be a stored table: its chunks are cut twice and have to agree (checked).

Defined results: a null or empty text has no ids; repeated rows are encoded one by
one; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import functools
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.llm import tokens
from kvartal.llm.shared import partitions

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a chunk, but for its last text.
CHUNK = 3_000_000
ENCODED = "doc_id long, n_tokens long, ids binary"


@functools.lru_cache(maxsize=1)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=1)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _pack_words(words: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return _squeeze(struct.pack("<I", len(words)) + lens.tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    data = _expand(data)
    (n,) = struct.unpack_from("<I", data)
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)).tolist()
    body = data[4 + 4 * n :]
    return [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _planes(numbers: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers: the high ones are nearly empty."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view("<u4").reshape(-1)


class _Chunk:
    """Texts of a chunk as numbers of its distinct words, in order of first appearance.

    Frequent words come early, so most numbers are small.
    """

    def __init__(self, number: int, docs: list[tuple[int | None, list[str]]]) -> None:
        self.number, self.docs = number, docs
        self.words = dict.fromkeys(chain.from_iterable(words for _, words in docs))
        self.bytes = [w.encode() for w in self.words]

    def buckets(self, n: int) -> np.ndarray:
        return np.fromiter(map(zlib.crc32, self.bytes), dtype=np.uint32, count=len(self.bytes)) % n

    def places(self) -> bytes:
        number = {w: k for k, w in enumerate(self.words)}
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(w for _, w in self.docs)), dtype=np.int64)
        known = np.array([d is not None for d, _ in self.docs], dtype=np.uint8)
        ids = np.array([d or 0 for d, _ in self.docs], dtype="<i8")
        lens = np.array([len(words) for _, words in self.docs], dtype="<u4")
        head = struct.pack("<III", len(ids), len(flat), len(self.words))
        return _squeeze(head + known.tobytes() + ids.tobytes() + lens.tobytes() + _planes(flat))


def _read_places(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    data = _expand(data)
    n, m, n_words = struct.unpack_from("<III", data)
    known = np.frombuffer(data, np.uint8, n, 12)
    ids = np.frombuffer(data, "<i8", n, 12 + n)
    lens = np.frombuffer(data, "<u4", n, 12 + 9 * n)
    flat = _unplanes(data[12 + 13 * n :], m)
    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], lens, flat, n_words


def _chunks(batches: Iterator, pattern: str) -> Iterator[_Chunk]:
    """Chunks of a task's rows; the same whenever the same rows come in the same order."""
    import regex
    from pyspark import TaskContext

    find = regex.compile(pattern).findall
    task, n, held = TaskContext.get().partitionId(), 0, 0
    docs: list[tuple[int | None, list[str]]] = []
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            docs.append((doc.as_py(), find(text)))
            held += len(text)
            if held >= CHUNK:
                yield _Chunk(task << 33 | n, docs)
                docs, n, held = [], n + 1, 0
    if docs:
        yield _Chunk(task << 33 | n, docs)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, 32 bits) of every text."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    where = path or tokens.default_path(VOCABULARY)
    n_buckets = 4 * partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def asked(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in _chunks(batches, pattern):
            bucket = chunk.buckets(n_buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = [chunk.bytes[k] for k in order[a:b]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array([int(bucket[order[a]])], pa.int32()),
                        "chunk": pa.array([chunk.number], pa.int64()),
                        "words": pa.array([_pack_words(part)], pa.binary()),
                    }
                )

    def answered(group):
        import pyarrow as pa

        coder, known = _encoding(where, pattern), {}
        out = []
        for data in group.column("words").to_pylist():
            words = _unpack_words(data)
            for w in words:
                if w not in known:
                    known[w] = np.array(coder.encode_ordinary(w.decode()), dtype="<u4").tobytes()
            out.append(_pack_words([known[w] for w in words]))
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "ids": pa.array(out, pa.binary())})

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in _chunks(batches, pattern):
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([chunk.number], pa.int64()),
                    "order": pa.array([_squeeze(chunk.buckets(n_buckets).astype("<u4").tobytes())], pa.binary()),
                    "places": pa.array([chunk.places()], pa.binary()),
                }
            )

    def joined(left, right):
        import pyarrow as pa

        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids": []}
        answers = dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True))
        for order, places in zip(left.column("order").to_pylist(), left.column("places").to_pylist(), strict=True):
            doc_ids, lens, flat, n_words = _read_places(places)
            bucket = np.frombuffer(_expand(order), "<u4")
            by_word: list[bytes] = [b""] * n_words
            for b in np.unique(bucket).tolist():
                which = np.flatnonzero(bucket == b).tolist()
                for k, ids in zip(which, _unpack_words(answers[b]), strict=True):
                    by_word[k] = ids
            ends = np.cumsum(lens).tolist()
            flat = flat.tolist()
            for doc, a, b in zip(doc_ids, [0, *ends], ends, strict=False):
                ids = b"".join(map(by_word.__getitem__, flat[a:b]))
                out["doc_id"].append(doc)
                out["n_tokens"].append(len(ids) // 4)
                out["ids"].append(ids)
        if right.num_rows and not left.num_rows:
            raise ValueError("the documents came in another order the second time; store them as a table first")
        types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    words = rows.mapInArrow(asked, "bucket int, chunk long, words binary")
    ids = words.groupBy("bucket").applyInArrow(answered, "chunk long, bucket int, ids binary")
    places = rows.mapInArrow(placed, "chunk long, order binary, places binary")
    return places.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(joined, ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the column decoded: the bytes of its ids, by the vocabulary's table."""
    where = path or tokens.default_path(VOCABULARY)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = {k: token for token, k in ranks(where).items()}
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            out = [
                b"".join(map(table.__getitem__, np.frombuffer(ids.as_py() or b"", "<u4").tolist()))
                for ids in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"]
            )

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
