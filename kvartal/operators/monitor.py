"""Monitor cycle in batch: due users, jobs, summaries, retention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions import text as tx

BATCH_USERS = 50
SEEN_DAYS = 30
LISTING_DAYS = 90


def due(last_checked: Column, interval_minutes: Column, now: Column) -> Column:
    """Never checked, or the interval has passed."""
    next_at = last_checked + F.make_dt_interval(mins=interval_minutes)
    return F.coalesce(next_at <= now, F.lit(True))


def targets(users: DataFrame, settings: DataFrame, criteria: DataFrame) -> DataFrame:
    """Users with monitoring switched on and active criteria."""
    on = settings.where(F.col("is_enabled"))
    live = criteria.where(F.col("is_active")) if "is_active" in criteria.columns else criteria
    return users.join(on, "user_id").join(live, "user_id")


def due_targets(rows: DataFrame, now: Column, limit: int | None = BATCH_USERS) -> DataFrame:
    """Due targets, never checked ones first; the limit applies after the test."""
    ready = rows.where(due(F.col("last_checked_at"), F.col("interval_minutes"), now))
    if limit is None:
        return ready
    return ready.orderBy(F.col("last_checked_at").asc_nulls_first(), "user_id").limit(limit)


def job_id(user: Column | str, at: Column | str) -> Column:
    minute = F.date_format(F.date_trunc("minute", tx.col(at)), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.concat_ws(":", F.lit("monitor"), tx.col(user).cast("string"), minute)


def minute_jobs(requests: DataFrame, at: str = "ts") -> DataFrame:
    """One job per user and minute; ``requests`` counts the merged requests."""
    return requests.groupBy("user_id", F.date_trunc("minute", F.col(at)).alias("minute")).agg(
        F.count(F.lit(1)).alias("requests"), F.min(at).alias("first_at")
    )


def enqueue(ready: DataFrame, queued: DataFrame, at: Column) -> DataFrame:
    """Due targets with their job id and whether that job is already queued."""
    jobs = ready.select("user_id", job_id("user_id", at).alias("job_id"))
    known = queued.select("job_id").distinct().withColumn("__queued", F.lit(True))
    return jobs.join(known, "job_id", "left").select(
        "user_id", "job_id", F.col("__queued").isNull().alias("enqueued")
    )


def enqueue_summary(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count(F.lit(1)).alias("due_users"),
        F.count_if("enqueued").alias("enqueued_jobs"),
        F.count_if(~F.col("enqueued")).alias("skipped_jobs"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Totals over (user_id, new_listings, error) rows; an error counts no news."""
    ok = F.col("error").isNull()
    news = F.when(ok, F.coalesce("new_listings", F.lit(0))).otherwise(F.lit(0))
    return results.agg(
        F.count(F.lit(1)).alias("processed_users"),
        F.count_if(news > 0).alias("notified_users"),
        F.coalesce(F.sum(news), F.lit(0)).cast("bigint").alias("new_listings"),
        F.count_if(~ok).alias("failed_users"),
    )


def touch(settings: DataFrame, results: DataFrame, checked_at: Column) -> DataFrame:
    """New last_checked_at for users without an error; failed users stay due."""
    done = results.where(F.col("error").isNull()).select("user_id").distinct()
    marked = settings.join(done.withColumn("__done", F.lit(True)), "user_id", "left")
    return marked.withColumn(
        "last_checked_at", F.when(F.col("__done"), checked_at).otherwise(F.col("last_checked_at"))
    ).drop("__done")


def stale_listings(listings: DataFrame, feedback: DataFrame, now: Column, days: int = LISTING_DAYS) -> DataFrame:
    """Old listings nobody decided on (null-safe, unlike NOT IN)."""
    old = listings.where(F.col("created_at") < now - F.make_dt_interval(F.lit(days)))
    return old.join(feedback.select("listing_id"), "listing_id", "left_anti")


def purge(
    criteria: DataFrame,
    seen: DataFrame,
    listings: DataFrame,
    feedback: DataFrame,
    now: Column,
    seen_days: int = SEEN_DAYS,
    listing_days: int = LISTING_DAYS,
) -> dict[str, DataFrame]:
    """What retention keeps. Seen rows of a purged listing go with it."""
    gone = stale_listings(listings, feedback, now, listing_days).select("listing_id")
    recent = seen.where(F.col("first_seen_at") >= now - F.make_dt_interval(F.lit(seen_days)))
    return {
        "criteria": criteria.where(F.col("is_active")),
        "seen": recent.join(gone, "listing_id", "left_anti"),
        "listings": listings.join(gone, "listing_id", "left_anti"),
    }


def purge_counts(
    criteria: DataFrame, seen: DataFrame, listings: DataFrame, feedback: DataFrame, now: Column
) -> DataFrame:
    """Deleted rows per table; cascaded seen rows are not counted."""
    parts = {
        "inactive_criteria": criteria.where(~F.col("is_active")),
        "old_seen": seen.where(F.col("first_seen_at") < now - F.make_dt_interval(F.lit(SEEN_DAYS))),
        "old_listings": stale_listings(listings, feedback, now),
    }
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("part"), "deleted")
        out = one if out is None else out.unionByName(one)
    return out


def allowed_only(rows: DataFrame, allowlist: str, user: str = "user_id") -> DataFrame:
    """Keep listed users; ids are split on comma or semicolon, none means open."""
    ids = sorted({int(part) for part in re.split("[,;]", allowlist) if part.strip()})
    if not ids:
        return rows
    allowed = rows.sparkSession.createDataFrame([(i,) for i in ids], f"{user} bigint")
    return rows.join(allowed, user, "left_semi")
