"""Due monitors, jobs, summaries, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import scratch
from checks.state_checks import feedback, fold_sql, sql_ts, text_ts
from checks.views import sql
from kvartal.functions.interval import interval_minutes, interval_text
from kvartal.operators import monitor as mo
from kvartal.operators import retention as rt

AT = "2000-06-01 00:00:00"


def at():
    return F.lit(AT).cast("timestamp")


def _criteria(v):
    return v.table("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max_by(F.col("o_orderkey"), F.struct("o_orderdate", "o_orderkey")).alias("criteria_id"),
        F.max_by(F.col("o_orderstatus") != "F", F.struct("o_orderdate", "o_orderkey")).alias("is_active"),
    )


CRITERIA_SQL = """crit AS (SELECT o_custkey AS user_id, o_orderkey AS criteria_id, o_orderstatus <> 'F' AS is_active FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
ready AS (SELECT u.*, m.interval_minutes, m.last_checked_at, c.criteria_id FROM v_users u JOIN v_monitors m USING (user_id)
  JOIN crit c USING (user_id) WHERE m.is_enabled AND c.is_active)"""
DUE_SQL = f"coalesce(last_checked_at + INTERVAL 1 MINUTE * interval_minutes <= TIMESTAMP '{AT}', true)"


def _targets(v):
    return mo.targets(v.users, v.monitors, _criteria(v))


def k1(v):
    rows = v.monitors.where(mo.due(F.col("last_checked_at"), F.col("interval_minutes"), at()))
    return rows.select("user_id", "is_enabled", "interval_minutes")


def l13(v):
    return _targets(v).select("user_id", "telegram_user_id", "username", "criteria_id", "interval_minutes")


def w12(v):
    return mo.due_targets(_targets(v), at(), 50).select("user_id", text_ts("last_checked_at"))


def k2(v):
    coarse = v.actions.withColumn("ts", F.date_trunc("hour", "ts"))
    return mo.minute_jobs(coarse).select("user_id", text_ts("minute"), "requests")


def _jobs(v):
    ready = mo.due_targets(_targets(v), at(), None)
    queued = ready.where(F.col("user_id") % 7 == 0).select(mo.job_id("user_id", at()).alias("job_id"))
    return mo.enqueue(ready, queued, at())


def a7(v):
    return mo.enqueue_summary(_jobs(v))


def a6(v):
    results = v.table("orders").select(
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 5).alias("new_listings"),
        F.when(F.col("o_orderstatus") == "P", "boom").alias("error"),
    )
    return mo.run_summary(results)


def k4(v):
    results = v.table("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max(F.when(F.col("o_orderkey") % 11 == 0, "boom")).alias("error")
    )
    return mo.touch(v.monitors, results, at()).select("user_id", text_ts("last_checked_at"))


def k5(v):
    """Users that stay due because their run failed."""
    results = v.table("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max(F.when(F.col("o_orderkey") % 11 == 0, "boom")).alias("error")
    )
    after = mo.touch(v.monitors, results, at())
    return after.where(mo.due(F.col("last_checked_at"), F.col("interval_minutes"), at())).select("user_id")


def _tables(v):
    criteria = v.table("orders").select(
        F.col("o_orderkey").alias("criteria_id"), (F.col("o_orderstatus") != "F").alias("is_active")
    )
    seen = v.decisions.where(F.col("op") == "purge").groupBy("user_id", "listing_id").agg(
        F.min("ts").alias("first_seen_at")
    )
    listings = v.table("part").select(
        F.col("p_partkey").alias("listing_id"),
        (F.lit("2024-02-01").cast("timestamp") - F.make_dt_interval(F.col("p_size") * 3)).alias("created_at"),
    )
    fb = feedback(v)
    return criteria, seen, listings, fb


PURGE_AT = "2024-02-10 00:00:00"
PURGE_SQL = f"""
, seen AS (SELECT user_id, listing_id, min(ts) AS first_seen_at FROM v_decisions WHERE op = 'purge' GROUP BY ALL),
lst AS (SELECT p_partkey AS listing_id, TIMESTAMP '2024-02-01' - INTERVAL 1 DAY * (p_size * 3) AS created_at FROM part),
gone AS (SELECT l.listing_id FROM lst l WHERE created_at < TIMESTAMP '{PURGE_AT}' - INTERVAL 90 DAY
  AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.listing_id = l.listing_id)),
recent AS (SELECT * FROM seen WHERE first_seen_at >= TIMESTAMP '{PURGE_AT}' - INTERVAL 30 DAY)
"""


def k9(v):
    kept = mo.purge(*_tables(v), F.lit(PURGE_AT).cast("timestamp"))
    return (
        kept["criteria"].select(F.lit("criteria").alias("part"), F.col("criteria_id").alias("id"), F.lit(0).cast("bigint").alias("user_id"))
        .unionByName(kept["seen"].select(F.lit("seen").alias("part"), F.col("listing_id").alias("id"), "user_id"))
        .unionByName(kept["listings"].select(F.lit("listings").alias("part"), F.col("listing_id").alias("id"), F.lit(0).cast("bigint").alias("user_id")))
    )


def _purged(v):
    """Seen rows and listings as tables by day, purged in place."""
    _, seen, listings, fb = _tables(v)
    root = scratch.folder(v.spark, "retention")
    tables = (
        rt.DatedTable("seen", f"{root}/seen", "first_seen_at", seen.schema),
        rt.DatedTable("listings", f"{root}/listings", "created_at", listings.schema),
    )
    for table, rows in zip(tables, (seen, listings), strict=True):
        table.write(rows)
    return tables, rt.purge(*tables, fb, F.lit(PURGE_AT).cast("timestamp"), f"{root}/work")


def k9_partitions(v):
    return _purged(v)[1].withColumn("day", F.col("day").cast("string"))


def k9_rows(v):
    (seen, listings), _ = _purged(v)
    return (
        seen.read(v.spark).select(F.lit("seen").alias("part"), F.col("listing_id").alias("id"), "user_id")
        .unionByName(listings.read(v.spark).select(F.lit("listings").alias("part"), F.col("listing_id").alias("id"), F.lit(0).cast("bigint").alias("user_id")))
    )


def a8(v):
    return mo.purge_counts(*_tables(v), F.lit(PURGE_AT).cast("timestamp"))


def l21(v):
    _, _, listings, fb = _tables(v)
    return mo.stale_listings(listings, fb, F.lit(PURGE_AT).cast("timestamp")).select("listing_id")


def f5(v):
    rows = mo.allowed_only(v.actions, "1,2;3, 5;;8").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    open_rows = mo.allowed_only(v.actions, " ; ").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(open_rows.select(F.lit(-1).cast("bigint").alias("user_id"), "n"))


def p28(v):
    text = F.concat(
        F.lit(" "), (F.col("p_partkey") % 40).cast("string"), F.lit(" "),
        F.element_at(F.array(F.lit("m"), F.lit("h"), F.lit("D"), F.lit("w")), (F.col("p_size") % 4 + 1).cast("int")),
    )
    minutes = interval_minutes(text)
    return v.table("part").select(
        "p_partkey", minutes.alias("minutes"), interval_text(minutes).alias("back"),
        interval_text(F.col("p_size") * 30).alias("shown"),
    )


CHECKS = {
    "K1_due_monitors": (k1, sql(f"SELECT user_id, is_enabled, interval_minutes FROM v_monitors WHERE {DUE_SQL}", "v_monitors")),
    "L13_monitor_targets": (
        l13,
        sql("WITH " + CRITERIA_SQL + " SELECT user_id, telegram_user_id, username, criteria_id, interval_minutes FROM ready", "v_users", "v_monitors"),
    ),
    "W12_due_list": (
        w12,
        sql("WITH " + CRITERIA_SQL + f""" SELECT user_id, {sql_ts('last_checked_at')} FROM (SELECT * FROM ready WHERE {DUE_SQL}
ORDER BY last_checked_at NULLS FIRST, user_id LIMIT 50)""", "v_users", "v_monitors"),
    ),
    "K2_job_per_user_minute": (
        k2,
        """SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS minute, count(*) AS requests
FROM events GROUP BY ALL""",
    ),
    "A7_enqueue_summary": (
        a7,
        sql("WITH " + CRITERIA_SQL + f""" SELECT count(*) AS due_users, count(*) FILTER (user_id % 7 <> 0) AS enqueued_jobs,
  count(*) FILTER (user_id % 7 = 0) AS skipped_jobs FROM ready WHERE {DUE_SQL}""", "v_users", "v_monitors"),
    ),
    "A6_run_summary": (
        a6,
        """SELECT count(*) AS processed_users, count(*) FILTER (ok AND n > 0) AS notified_users,
  CAST(sum(n) FILTER (ok) AS BIGINT) AS new_listings, count(*) FILTER (NOT ok) AS failed_users
FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 END AS n, o_orderstatus <> 'P' AS ok FROM orders)""",
    ),
    "K4_touch_last_checked": (
        k4,
        sql(
            f"""SELECT user_id, strftime(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id) AND NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderkey % 11 = 0) THEN TIMESTAMP '{AT}' ELSE last_checked_at END,
  '%Y-%m-%d %H:%M:%S.%f') AS last_checked_at FROM v_monitors""",
            "v_monitors",
        ),
    ),
    "K5_failed_stay_due": (
        k5,
        sql(
            f"""SELECT user_id FROM v_monitors WHERE {DUE_SQL} AND (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id)
  OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND o_orderkey % 11 = 0))""",
            "v_monitors",
        ),
    ),
    "K9_retention_purge": (
        k9,
        fold_sql(
            PURGE_SQL.strip() + """
SELECT 'criteria' AS part, o_orderkey AS id, CAST(0 AS BIGINT) AS user_id FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT 'seen', listing_id, user_id FROM recent r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.listing_id = r.listing_id)
UNION ALL SELECT 'listings', listing_id, 0 FROM lst l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.listing_id = l.listing_id)"""
        ),
    ),
    "K9_purge_partitions": (
        k9_partitions,
        fold_sql(
            PURGE_SQL.strip() + f"""
, told AS (SELECT 'seen' AS part, first_seen_at AS made, first_seen_at >= TIMESTAMP '{PURGE_AT}' - INTERVAL 30 DAY
    AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.listing_id = s.listing_id) AS stays FROM seen s
  UNION ALL SELECT 'listings', created_at, NOT EXISTS (SELECT 1 FROM gone g WHERE g.listing_id = l.listing_id) FROM lst l)
SELECT part, strftime(made, '%Y-%m-%d') AS day, CASE WHEN bool_or(stays) THEN 'rewritten' ELSE 'dropped' END AS action,
  count(*) FILTER (WHERE NOT stays) AS deleted, count(*) FILTER (WHERE stays) AS kept
FROM told GROUP BY 1, 2 HAVING NOT bool_and(stays)"""
        ),
    ),
    "K9_purged_rows": (
        k9_rows,
        fold_sql(
            PURGE_SQL.strip() + """
SELECT 'seen' AS part, listing_id AS id, user_id FROM recent r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.listing_id = r.listing_id)
UNION ALL SELECT 'listings', listing_id, 0 FROM lst l WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.listing_id = l.listing_id)"""
        ),
    ),
    "A8_purge_counts": (
        a8,
        fold_sql(
            PURGE_SQL.strip() + """
SELECT 'inactive_criteria' AS part, count(*) AS deleted FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'old_seen', (SELECT count(*) FROM seen) - (SELECT count(*) FROM recent)
UNION ALL SELECT 'old_listings', count(*) FROM gone"""
        ),
    ),
    "L21_purge_guard": (l21, fold_sql(PURGE_SQL.strip() + " SELECT listing_id FROM gone")),
    "F5_allowlist": (
        f5,
        """SELECT user_id, count(*) AS n FROM events WHERE user_id IN (1, 2, 3, 5, 8) GROUP BY 1
UNION ALL SELECT -1, count(*) FROM events""",
    ),
    "P28_interval_text": (
        p28,
        """WITH i AS (SELECT *, CASE WHEN m BETWEEN 15 AND 10080 THEN m END AS minutes FROM (
  SELECT p_partkey, p_size, (p_partkey % 40) * CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 1440 END AS m FROM part))
SELECT p_partkey, minutes, CASE WHEN minutes % 1440 = 0 THEN minutes // 1440 || 'd' WHEN minutes % 60 = 0 THEN minutes // 60 || 'h'
  ELSE minutes || 'm' END AS back,
  CASE WHEN p_size * 30 % 1440 = 0 THEN p_size * 30 // 1440 || 'd' WHEN p_size * 30 % 60 = 0 THEN p_size * 30 // 60 || 'h'
  ELSE p_size * 30 || 'm' END AS shown FROM i""",
    ),
}
