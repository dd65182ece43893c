"""Run queries beside their SQL and compare the results.

    python -m checks.compare [sf_dir] [key prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.registry import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kvartal-checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr), sorted(names)


def compare(spark: SparkSession, con, sf_dir: str, key: str, build, text: str | None):
    started = time.time()
    df = build(spark, sf_dir)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if text is None:
        return "rows-only", len(got), took, ""
    cur = con.execute(text)
    want, want_names = rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return "FAIL", len(got), took, f"columns {names} != {want_names}"
    if got != want:
        a, b = set(got), set(want)
        detail = f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b, key=repr)[:3]}; only sql {sorted(b - a, key=repr)[:3]}"
        return "FAIL", len(got), took, detail
    return "ok" if got else "EMPTY", len(got), took, ""


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = session(), connect(sf_dir)
    texts, bad = oracle_sql(), 0
    for key, build in queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        try:
            state, n, took, detail = compare(spark, con, sf_dir, key, build, texts.get(key))
        except Exception as exc:  # report and go on with the next query
            state, n, took, detail = "ERROR", 0, 0.0, str(exc)[:1500]
        bad += state in ("FAIL", "ERROR")
        print(f"{state:9} {key:38} rows={n:<8} {took:6.2f}s {detail}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
