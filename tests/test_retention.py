"""Retention on tables by day: what is rewritten, dropped, and left alone."""

import datetime as dt
import os

from pyspark.sql import functions as F

from kvartal.operators import retention as rt

NOW = dt.datetime(2026, 6, 1, 12)
SEEN = "user_id long, listing_id long, first_seen_at timestamp"
LISTINGS = "listing_id long, title string, created_at timestamp"


def _ago(days, hours=0):
    return NOW - dt.timedelta(days=days, hours=hours)


def _files(root):
    return {
        (os.path.basename(folder), name)
        for folder, _, names in os.walk(root) for name in names if name.endswith(".parquet")
    }


def _tables(spark, path, seen, listings):
    rows = spark.createDataFrame(seen, SEEN), spark.createDataFrame(listings, LISTINGS)
    tables = (
        rt.DatedTable("seen", f"{path}/seen", "first_seen_at", rows[0].schema),
        rt.DatedTable("listings", f"{path}/listings", "created_at", rows[1].schema),
    )
    for table, part in zip(tables, rows, strict=True):
        table.write(part)
    return tables


def _purge(spark, path, tables, kept=()):
    feedback = spark.createDataFrame([(i,) for i in kept], "listing_id long")
    out = rt.purge(*tables, feedback, F.lit(NOW), f"{path}/work")
    return sorted((r.part, r.action, r.deleted, r.kept) for r in out.collect())


def test_only_days_that_lose_rows_change(spark, tmp_path):
    seen = [
        (1, 9, _ago(40)), (1, 8, _ago(40)),  # a day of old rows
        (1, 9, _ago(30)), (2, 9, _ago(30, 1)),  # the day of the limit: one stays, one goes
        (1, 9, _ago(5)), (2, 1, _ago(5)),  # one of a purged listing
        (1, 9, _ago(4)), (3, 9, _ago(4)),  # untouched
        (4, 9, None),
    ]
    listings = [
        (1, "old", _ago(100)), (2, "kept", _ago(100)), (3, "old", _ago(101)),
        (4, "edge", _ago(90)), (5, "past", _ago(90, 1)), (9, "new", _ago(2)), (7, "none", None), (None, "null", _ago(100)),
    ]
    tables = _tables(spark, str(tmp_path), seen, listings)
    before = [_files(t.root) for t in tables]
    assert _purge(spark, tmp_path, tables, kept=(2,)) == [
        ("listings", "dropped", 1, 0), ("listings", "rewritten", 1, 1), ("listings", "rewritten", 1, 2),
        ("seen", "dropped", 2, 0), ("seen", "rewritten", 1, 1), ("seen", "rewritten", 1, 1),
    ]
    after = [_files(t.root) for t in tables]
    gone = [{folder for folder, _ in old - new} for old, new in zip(before, after, strict=True)]
    day = lambda at: f"day={at.date()}"
    assert gone == [{day(_ago(n)) for n in (40, 30, 5)}, {day(_ago(n)) for n in (100, 101, 90)}]
    left = tables[1].read(spark)
    assert sorted(r.title for r in left.collect()) == ["edge", "kept", "new", "none", "null"]
    assert tables[0].read(spark).count() == 5
    assert not os.path.exists(f"{tables[1].root}/{day(_ago(101))}")
    # once more: nothing to do, no file moves
    assert _purge(spark, tmp_path, tables, kept=(2,)) == []
    assert [_files(t.root) for t in tables] == after


def test_days_after_the_limit_are_not_read(spark, tmp_path):
    _, listings = _tables(spark, str(tmp_path), [], [(1, "a", _ago(100)), (2, "b", _ago(1))])
    old = listings.read(spark).where(F.col("day") <= F.to_date(F.lit(NOW) - F.make_dt_interval(F.lit(90))))
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and len(old.inputFiles()) == 2
    assert {os.path.basename(os.path.dirname(f)) for f in _read_files(old)} == {f"day={_ago(100).date()}"}


def _read_files(rows):
    return [r.f for r in rows.select(F.input_file_name().alias("f")).distinct().collect()]


def test_empty_tables(spark, tmp_path):
    assert _purge(spark, tmp_path, _tables(spark, str(tmp_path), [], [])) == []
