"""Folders for intermediate tables and other small helpers."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"


@functools.lru_cache(maxsize=1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="run-llm-")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a local master gets a temporary folder; a cluster is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and lost executors lose nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{BLANK_CLASS}+"))


def row_id() -> Column:
    """A number per row, the same in each scan of a stored table (file order gives it)."""
    return F.monotonically_increasing_id()


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): each row under its number, its columns inside one, so that no name clashes."""
    return docs.select(row_id().alias("row"), F.struct("*").alias("doc"))


def with_text(docs: DataFrame, text: Column, changed: Column) -> Column:
    """``doc`` of a numbered row with another text where ``changed``; n_chars, where present, follows it."""
    new = F.col("doc").withField("text", text)
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return F.when(changed, new).otherwise(F.col("doc"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it, that is no column of ``df`` (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Batches that go to Python hold ``most`` bytes, so long texts don't add up in a worker.

    A setting of the session, lowered where it is higher; no result depends on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(now[:-1]) * units[now[-1]] if now[-1] in units else int(now)
    if not 0 < size <= most:
        spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
