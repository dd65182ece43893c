"""Documents to training sequences, stage by stage.

``run`` takes the documents of a folder through STAGES. Every stage's result is written
as Parquet to the shared folder and read again as the next one's input, so lineage
ends at each stage and lost executors cost at most the current one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvartal.llm import near_duplicates, packing, quality_classifier, quality_rules, substring_dedup
from kvartal.llm.shared import written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a host repeat go, and documents that fail the rules."""
    return quality_rules.apply(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that trees fitted on the labelled ones take for bad."""
    return quality_classifier.apply(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return near_duplicates.apply(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere go from the texts."""
    return substring_dedup.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of binary lengths with their ids."""
    return packing.pieces(docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near-duplicates", one_of_each),
    ("substring dedup", passages),
    ("packing", packed),
]

#: Trained scores, components and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
