"""Packing by power-of-two decomposition: pieces of binary lengths, bucketed by length.

A document of n tokens becomes n // limit pieces of the limit and one piece for each
bit of the rest, longest first. A piece is a whole sequence of its bucket, so a
sequence never crosses documents and nothing is padded; a batch takes sequences of one
bucket.

A sequence id holds the bucket (the power), the task and a counter inside both; so ids
are unique without a shuffle or a global count. Texts are encoded where they are read.

Defined results: a null or empty text is its end id alone; repeated rows are packed one
by one; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kvartal.llm import tokens
from kvartal.llm.shared import bounded_batches

LIMIT = 4096
END = 2
VOCABULARY = "word_bpe_49k.json"
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, path: str | None = None, end: int = END, limit: int = LIMIT) -> DataFrame:
    """A row per piece with its ids (little-endian, 32 bits); ``limit`` is a power of two."""
    if limit & (limit - 1) or limit <= 0:
        raise ValueError("limit must be a power of two")
    bounded_batches(docs.sparkSession)
    vocabulary = path or tokens.default_path(VOCABULARY)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        schema = pa.schema(
            [pa.field(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECES.fields]
        )
        task = TaskContext.get().partitionId()
        encode = tokens.encoder(vocabulary, spaced=False)
        stop = end.to_bytes(4, "little")
        made: Counter[int] = Counter()

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            held = 0
            texts = (x.as_py() for x in batch.column(1))
            for doc, body in zip(batch.column(0).to_pylist(), encode.texts(texts), strict=True):
                ids = body + stop
                total, start = len(ids) // 4, 0
                for n in lengths(total, limit):
                    power = n.bit_length() - 1
                    sequence = power << 57 | task << 33 | made[power]
                    rows.append((doc, start, n, total, sequence, 0, ids[4 * start : 4 * (start + n)]))
                    made[power] += 1
                    start += n
                held += len(ids)
                if held > 4_000_000:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(run, PIECES)


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per sequence length; a reader draws batches from one folder at a time."""
    packed.write.partitionBy("length").parquet(path)
