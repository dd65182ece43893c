"""Versioned parquet snapshots: write a new one whole, read the newest whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, text: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions (those with a success marker), oldest first."""
    path = _path(spark, root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        marker = _path(spark, f"{root}/{name}/_SUCCESS")
        if name.startswith("version=") and fs.exists(marker):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def write(df: DataFrame, root: str) -> int:
    """Write the next version. A reader sees it only once it is complete, and the
    frame may itself be derived from the version it replaces. Two writers never get
    the same number: it is claimed by a file that only one of them can create."""
    spark = df.sparkSession
    known = versions(spark, root)
    version = (known[-1] if known else 0) + 1
    fs = _path(spark, root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while not fs.createNewFile(_path(spark, f"{root}/_claim-{version}")):
        version += 1
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    return version


def read(spark: SparkSession, root: str) -> DataFrame:
    known = versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no complete snapshot under {root}")
    return spark.read.parquet(f"{root}/version={known[-1]}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table; none is no error."""
    target = _path(spark, path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
