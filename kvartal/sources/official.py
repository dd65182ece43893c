"""The official classifier sheet as CSV or parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SHEET = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("te", "ab", "cd", "ef", "hij", "k", "kaz_name", "rus_name")]
)


def read(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """All columns as text: codes keep their leading zeros."""
    reader = spark.read.schema(SHEET)
    return reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)
