"""Retention as writes: tables partitioned by day, of which only days that lose rows are touched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.operators import monitor as mo
from kvartal.sources.snapshots import delete

REPORT = "part string, day date, action string, deleted long, kept long"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class DatedTable:
    """A Parquet table under ``root`` with a folder per day of its time column ``at``."""

    name: str
    root: str
    at: str
    schema: T.StructType

    def write(self, rows: DataFrame) -> None:
        """The whole table, or its days that ``rows`` hold; other days stay as they are.

        Spark sizes the files: a busy day is split over tasks, quiet days share one.
        """
        placed = rows.select(*self.schema.fieldNames()).withColumn("day", F.to_date(self.at)).hint("rebalance", "day")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.root)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType(self.schema.fields).add("day", T.DateType())).parquet(self.root)


def _on(days: list) -> Column:
    """Rows of these days; tested on the partition column alone, so other days are not read."""
    known = F.col("day").isin([d for d in days if d is not None])
    return known | F.col("day").isNull() if None in days else known


def drop_rows(table: DatedTable, judged: DataFrame, work: str) -> list[tuple]:
    """Remove the rows of ``judged`` (rows of the table with ``stays``) that do not stay.

    Days are counted first: those that lose nothing are left alone, those that lose
    everything are deleted as folders, the others are rewritten. Their rows go to ``work``
    before a file is replaced: lost executors repeat their tasks, and a driver lost while
    days are moved into place leaves the rows of these days there. The driver sees one row per day that changes: (name, day, action, deleted, kept).
    """
    spark = judged.sparkSession
    tally = judged.groupBy("day").agg(
        F.count_if(~F.col("stays")).alias("deleted"), F.count_if("stays").alias("kept")
    )
    changed = [(r.day, r.deleted, r.kept) for r in tally.where("deleted > 0").collect()]
    rewritten = [day for day, _, kept in changed if kept]
    if rewritten:
        path = f"{work}/{table.name}"
        judged.where(_on(rewritten) & F.col("stays")).select(*table.schema.fieldNames()).write.mode("overwrite").parquet(path)
        table.write(spark.read.schema(table.schema).parquet(path))
    for day, _, kept in changed:
        if not kept:
            delete(spark, f"{table.root}/day={day or NO_DAY}")
    return [(table.name, day, "rewritten" if kept else "dropped", gone, kept) for day, gone, kept in changed]


def purge(
    seen: DatedTable,
    listings: DatedTable,
    feedback: DataFrame,
    now: Column,
    work: str,
    seen_days: int = mo.SEEN_DAYS,
    listing_days: int = mo.LISTING_DAYS,
) -> DataFrame:
    """Old seen rows and old listings nobody decided on leave their tables; a report of the days that changed.

    Seen rows of a purged listing go with it. Of the listings only days up to the limit are
    read. Seen rows go first, so a run that was cut off finds the same listings again.
    Rows without a time are never old. ``feedback`` needs listing_id only.
    """
    spark = feedback.sparkSession
    limit = now - F.make_dt_interval(F.lit(listing_days))
    old = listings.read(spark).where(F.col("day") <= F.to_date(limit))
    gone = mo.stale_listings(old.withColumn("created_at", F.col(listings.at)), feedback, now, listing_days)
    gone.select("listing_id").distinct().write.mode("overwrite").parquet(f"{work}/gone")
    gone = spark.read.parquet(f"{work}/gone").withColumn("gone", F.lit(True))

    def without_gone(rows: DataFrame, stays: Column) -> DataFrame:
        kept = rows.join(gone, "listing_id", "left")
        return kept.withColumn("stays", F.col("gone").isNull() & stays).drop("gone")

    aged = F.col(seen.at) < now - F.make_dt_interval(F.lit(seen_days))
    report = drop_rows(seen, without_gone(seen.read(spark), ~F.coalesce(aged, F.lit(False))), work)
    report += drop_rows(listings, without_gone(old, F.lit(True)), work)
    return spark.createDataFrame(report, REPORT)
