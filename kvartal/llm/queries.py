"""One query per operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvartal.llm import (
    golay_simhash,
    kmeans_tree,
    near_duplicates,
    oracles,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    spelling_trie,
    substring_dedup,
    suffix_dedup,
    threshold_negatives,
    token_files,
    word_bpe,
)
from kvartal.llm.shared import folder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir)).drop("row", "removed")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_documents(spark, sf_dir)).drop("row")
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_documents(spark, sf_dir)).select("*", F.crc32("ids").alias("ids_crc32")).drop("ids")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classify(_documents(spark, sf_dir)).drop("row")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    forest = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    return quality_classifier.score(docs, forest).select(
        "doc_id",
        quality_classifier.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality_classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    token_files.write(_documents(spark, sf_dir), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.decode(word_bpe.encode(_documents(spark, sf_dir))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.classify(_documents(spark, sf_dir)).drop("row")


def op12_threshold_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return threshold_negatives.mine(threshold_negatives.prepared(table.withColumn("label", wrong)))


def op13_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.classify(_documents(spark, sf_dir))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_files": op7_token_files,
    "op8_word_bpe": op8_word_bpe,
    "op9_kmeans_tree": op9_kmeans_tree,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_golay_simhash": op11_golay_simhash,
    "op12_threshold_negatives": op12_threshold_negatives,
    "op13_spelling_trie": op13_spelling_trie,
}

#: Splitters, token ids, trained scores and calibrated search have no SQL form; tests compare them with brute force.
ORACLE_SQL = oracles.SQL
