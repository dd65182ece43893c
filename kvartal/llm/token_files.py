"""Token ids in binary files: Simple-8b blocks in ascending order of doc_id.

Documents are dealt out by ranges of doc_id and sorted; each task encodes its texts and
packs the ids into frames. A frame is a byte string: a header, the doc_ids and
lengths, the word offsets of its blocks, the words and the exceptions. Frames are
rows of Parquet files, so any store that Spark writes to can hold them and a file
appears only when its task has committed.

Where a document begins in the whole stream comes from counts: ids before it in its
task (stored) plus the sum of the tasks before.

Defined results: a null or empty text is its end id alone; a null doc_id comes first;
equal doc_ids follow each other, by text; an empty table gives an empty result. Only
doc_id and text are read. A text's ids lie in one frame, however long it is.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvartal.llm import simple8b, tokens
from kvartal.llm.shared import partitions

END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Ids of a frame, but for its last document.
FRAME = 1 << 18
MAGIC = b"S8B1"
HEAD = struct.Struct("<4sIQIII")
FRAMES = "part int, frame int, ids_before long, n_ids long, n_docs int, data binary"
DOCS = "part int, doc_id long, start_in_part long, n_tokens long, ids binary"


def pack(doc_ids: list[int | None], bodies: list[bytes]) -> bytes:
    """One frame: ids of several documents, each as little-endian 32-bit bytes."""
    values = np.frombuffer(b"".join(bodies), dtype="<u4").astype(np.uint64)
    words, offsets, exceptions = simple8b.encode(values)
    head = HEAD.pack(MAGIC, len(doc_ids), len(values), len(words), len(offsets), len(exceptions))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    ids = np.array([d or 0 for d in doc_ids], dtype="<i8")
    lens = np.array([len(b) // 4 for b in bodies], dtype="<u4")
    return b"".join(
        [head, known.tobytes(), ids.tobytes(), lens.tobytes(), offsets.astype("<u4").tobytes(),
         words.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes()]
    )


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths, and all ids of a frame."""
    magic, n_docs, n_ids, n_words, n_offsets, n_exceptions = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += found.nbytes
        return found

    known, ids, lens = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs)
    offsets, words, exceptions = take("<u4", n_offsets), take("<u8", n_words), take("<u8", n_exceptions)
    values = simple8b.decode(words, offsets, exceptions, n_ids)
    return [int(d) if k else None for d, k in zip(ids, known, strict=True)], lens, values.astype("<u4")


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END) -> None:
    """Encode all texts and write the files to ``path``."""
    where = vocabulary or tokens.default_path(VOCABULARY)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, stop, encode = TaskContext.get().partitionId(), end.to_bytes(4, "little"), tokens.encoder(where, spaced=True)
        frame, before, held = 0, 0, 0
        doc_ids: list[int | None] = []
        bodies: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal frame, before, held, doc_ids, bodies
            columns = {
                "part": pa.array([part], pa.int32()),
                "frame": pa.array([frame], pa.int32()),
                "ids_before": pa.array([before], pa.int64()),
                "n_ids": pa.array([held], pa.int64()),
                "n_docs": pa.array([len(doc_ids)], pa.int32()),
                "data": pa.array([pack(doc_ids, bodies)], pa.binary()),
            }
            frame, before, held, doc_ids, bodies = frame + 1, before + held, 0, [], []
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            texts = (x.as_py() for x in batch.column(1))
            for doc, body in zip(batch.column(0).to_pylist(), encode.texts(texts), strict=True):
                doc_ids.append(doc)
                bodies.append(body + stop)
                held += len(body) // 4 + 1
                if held >= FRAME:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, FRAMES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, 32 bits) of every document of the files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, lens, values = unpack(row["data"])
                ends = np.cumsum(lens, dtype=np.int64)
                starts, raw = ends - lens, values.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * len(doc_ids), pa.int32()),
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "start_in_part": pa.array(starts + row["ids_before"], pa.int64()),
                        "n_tokens": pa.array(lens, pa.int64()),
                        "ids": pa.array([raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)], pa.binary()),
                    }
                )

    frames = spark.read.schema(FRAMES).parquet(path)
    found = frames.select("part", "ids_before", "data").mapInArrow(run, DOCS)
    sums = frames.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumnRenamed("part", "of")
    order = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)  # a row per write task
    bases = sums.select("of", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    # One row per write task, whose number is a setting; so the ids themselves needn't move.
    return found.join(F.broadcast(bases), F.col("part") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids"
    )


