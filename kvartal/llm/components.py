"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.llm.shared import written


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and its neighbours, m. Combined in the map tasks first."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")).withColumnRenamed("u", "of")
    return edges.join(least, F.col("u") == F.col("of")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node it knows."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _least(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(found.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
        ).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link to another; component: its least node.

    ``edges``: (u, v) of whole numbers, any order, repeated ones and self-links allowed.
    Each round is written to the shared folder, so lineage stays short; rounds grow with
    the logarithm of the number of nodes. What the driver sees is a count and two sums.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        for star in (_large_star, _small_star):
            now = star(now).where("u <> v").distinct()
        now = written(now, "edges")
        last, mark = mark, _mark(now)
        if last == mark:
            break
    least = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return least.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
