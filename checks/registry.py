"""All checks by key."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from checks.views import Views

MODULES = (
    "match_checks",
    "state_checks",
    "decision_checks",
    "recommend_checks",
    "enrich_checks",
    "score_checks",
    "monitor_checks",
    "intent_checks",
    "history_checks",
    "extract_checks",
    "quality_checks",
    "stream_checks",
    "verified_checks",
)


def _all() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        for key, check in import_module(f"checks.{name}").CHECKS.items():
            assert key not in out, key
            out[key] = check
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Views(spark, sf_dir))

        return run

    return {key: runner(check[0]) for key, check in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {key: check[1] for key, check in _all().items() if check[1] is not None}
