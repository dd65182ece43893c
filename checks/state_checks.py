"""Upserts, decision life cycle, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Views, sql
from kvartal.operators import state as st

DUE = "2001-12-01 00:00:00"

FOLD = """
, ev AS (SELECT *, row_number() OVER (PARTITION BY user_id, listing_id ORDER BY ts, seq) AS n FROM {events}),
fold AS (
  SELECT DISTINCT user_id, listing_id, CAST(0 AS BIGINT) AS n, 'none' AS state,
    CAST(NULL AS TIMESTAMP) AS decided_at, CAST(NULL AS TIMESTAMP) AS deleted_at FROM ev
  UNION ALL
  SELECT f.user_id, f.listing_id, e.n,
    CASE e.op WHEN 'save' THEN 'saved' WHEN 'reject' THEN 'rejected'
      WHEN 'delete_saved' THEN CASE f.state WHEN 'saved' THEN 'trashed' ELSE f.state END
      WHEN 'restore' THEN CASE f.state WHEN 'trashed' THEN 'saved' WHEN 'rejected' THEN 'none' ELSE f.state END
      ELSE CASE WHEN f.state IN ('trashed', 'rejected', 'gone') THEN 'gone' ELSE f.state END END,
    CASE WHEN e.op IN ('save', 'reject') THEN e.ts WHEN e.op = 'restore' AND f.state = 'rejected' THEN NULL
      ELSE f.decided_at END,
    CASE WHEN e.op IN ('save', 'reject') THEN NULL WHEN e.op = 'delete_saved' AND f.state = 'saved' THEN e.ts
      WHEN e.op = 'restore' AND f.state = 'trashed' THEN NULL
      WHEN e.op = 'purge' AND f.state IN ('trashed', 'rejected', 'gone') THEN e.ts ELSE f.deleted_at END
  FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.listing_id = f.listing_id AND e.n = f.n + 1),
feedback AS (
  SELECT user_id, listing_id, CASE WHEN state IN ('saved', 'trashed') THEN 'saved' ELSE 'rejected' END AS decision,
    decided_at, deleted_at
  FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY user_id, listing_id ORDER BY n DESC) = 1)
  WHERE state <> 'none')
"""


def fold_sql(body: str, *names: str, events: str = "v_decisions", extra: str = "") -> str:
    base = sql("SELECT 1", "v_decisions", *names, recursive=True)
    head = base[: base.rindex("SELECT 1")]
    return head + extra + FOLD.format(events=events) + body


def text_ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


def feedback(v: Views):
    return st.feedback_state(v.decisions)


def fold_out(v):
    return feedback(v).select("user_id", "listing_id", "decision", text_ts("decided_at"), text_ts("deleted_at"))


FOLD_COLS = f"user_id, listing_id, decision, {sql_ts('decided_at')}, {sql_ts('deleted_at')}"


def e1(v):
    """One bulk save or reject per pair on an empty table."""
    rows = v.decisions.where(F.col("op").isin("save", "reject")).select(
        "user_id", "listing_id", F.when(F.col("op") == "save", "saved").otherwise("rejected").alias("decision"),
        F.col("ts").alias("decided_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(None).cast("string").alias("page_id"), F.lit(None).cast("timestamp").alias("synced_at"),
    )
    current = v.decisions.where(F.col("op") == "delete_saved").groupBy("user_id", "listing_id").agg(
        F.lit("saved").alias("decision"), F.min("ts").alias("decided_at"), F.min("ts").alias("deleted_at"),
        F.concat(F.lit("page-"), F.min("seq").cast("string")).alias("page_id"), F.min("ts").alias("synced_at"),
    )
    return st.apply_decisions(current, rows).select(
        "user_id", "listing_id", "decision", text_ts("decided_at"), text_ts("deleted_at"), "page_id"
    )


def e2(v):
    return st.trashed(feedback(v)).select("user_id", "listing_id", text_ts("deleted_at"))


def e3(v):
    """Rows that were restored are live again; the whole log is folded."""
    return feedback(v).select("user_id", "listing_id", text_ts("decided_at"), text_ts("deleted_at"))


def e4(v):
    return st.active(feedback(v), "rejected").select("user_id", "listing_id", text_ts("decided_at"))


def e5(v):
    return feedback(v).where((F.col("decision") == "rejected") & F.col("deleted_at").isNotNull()).select(
        "user_id", "listing_id", text_ts("deleted_at")
    )


def e6(v):
    seen = v.decisions.where(F.col("op") == "purge").select("user_id", "listing_id")
    rows = st.mark_seen(v.decisions, seen, F.lit(DUE).cast("timestamp"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("listing_id").alias("total"))


def e7(v):
    ev = v.decisions.withColumn("listing_id", F.col("listing_id") * 25)
    return st.feedback_state(st.known_only(ev, v.decided_listings)).select("user_id", "listing_id", "decision")


def _pairs(v):
    orders = v.table("orders").select("o_orderkey", "o_custkey")
    line = v.table("lineitem").select("l_orderkey", "l_partkey")
    return orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("o_custkey") % 150).alias("user_id"), (F.col("l_partkey") % 100).alias("listing_id")
    )


PAIRS_SQL = """, pairs AS (SELECT o_custkey % 150 AS user_id, l_partkey % 100 AS listing_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
"""


def l10(v):
    out = st.hide_decided(_pairs(v), feedback(v))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("listing_id").alias("total"))


def l11(v):
    seen = v.decisions.where(F.col("op") == "purge").select("user_id", "listing_id")
    return st.unseen(_pairs(v), seen).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("listing_id").alias("total")
    )


def l12(v):
    return st.feedback_listings(feedback(v), v.users, v.decided_listings).select(
        "telegram_user_id", "listing_id", "decision", "city", "price_kzt"
    )


def l9(v):
    line = v.table("lineitem")
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    keys = line.groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.transform(F.array_sort(F.collect_list(at)), lambda x: x["l_partkey"] * 2).alias("keys")
    )
    return st.by_request_order(keys, v.decided_listings, "listing_id").select(
        "request_id", "pos", "listing_id", "city"
    )


def a2(v):
    return st.count_active(feedback(v))


def u1(v):
    return st.trash_list(feedback(v)).select("user_id", "listing_id", "part", text_ts("at").alias("shown_at"), "rank")


def u2(v):
    rows = feedback(v).where(F.col("deleted_at").isNull()).join(v.decided_listings, "listing_id")
    sets = rows.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("decision") == "saved", F.col("district"))).alias("liked"),
        F.collect_set(F.when(F.col("decision") == "rejected", F.col("district"))).alias("rejected"),
    )
    only = F.array_sort(F.array_except("rejected", "liked"))
    return sets.select(
        "user_id", F.array_join(F.array_sort("liked"), ",").alias("liked"), F.array_join(only, ",").alias("disliked")
    )


def w11(v):
    fb = feedback(v)
    seen = v.decisions.where(F.col("op") == "purge").groupBy("user_id", "listing_id").agg(
        F.min("ts").alias("first_seen_at")
    )
    lists = [
        ("saved", st.newest(st.active(fb, "saved"), "decided_at")),
        ("rejected", st.newest(st.active(fb, "rejected"), "decided_at")),
        ("trashed", st.newest(st.trashed(fb), "deleted_at")),
        ("seen", st.newest(seen, "first_seen_at")),
    ]
    out = None
    for name, rows in lists:
        part = rows.select(F.lit(name).alias("list"), "user_id", "rank", "listing_id")
        out = part if out is None else out.unionByName(part)
    return out


W11_SQL = """
SELECT 'saved' AS list, user_id, rank, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY decided_at DESC, listing_id) AS rank FROM feedback WHERE decision = 'saved' AND deleted_at IS NULL) WHERE rank <= 10
UNION ALL SELECT 'rejected', user_id, rank, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY decided_at DESC, listing_id) AS rank FROM feedback WHERE decision = 'rejected' AND deleted_at IS NULL) WHERE rank <= 10
UNION ALL SELECT 'trashed', user_id, rank, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY deleted_at DESC, listing_id) AS rank FROM feedback WHERE decision = 'saved' AND deleted_at IS NOT NULL) WHERE rank <= 10
UNION ALL SELECT 'seen', user_id, rank, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY first_seen_at DESC, listing_id) AS rank FROM (SELECT user_id, listing_id, min(ts) AS first_seen_at
  FROM v_decisions WHERE op = 'purge' GROUP BY ALL)) WHERE rank <= 10
"""


def _stored(v):
    """(stored snapshot, scraped rows) of listings keyed by order and line."""
    rows = v.listings.select(
        F.lit("site").alias("source"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"),
        F.concat_ws("/", F.lit("https://example.com/a/show"), "l_orderkey", "l_linenumber").alias("url"),
        "price_kzt", "posted_by", F.col("published_at").alias("created_at"), "l_shipdate", "l_partkey", "l_suppkey",
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "price_kzt"]
    old = st.last_per_key(rows.where(F.col("posted_by") == "agent"), ["source", "external_id"], order)
    new = rows.where(F.col("posted_by") == "owner")
    return old.select("source", "external_id", "url", "price_kzt", "created_at"), new, order


def w1(v):
    old, new, order = _stored(v)
    out = st.merge(old, new, ["source", "external_id"], order, keep=["created_at"])
    return out.select("external_id", "price_kzt", text_ts("created_at"))


STORED_SQL = """
, rows AS (SELECT l_orderkey || '-' || l_linenumber AS external_id, * EXCLUDE (external_id) FROM v_listings),
old AS (SELECT * FROM rows WHERE posted_by = 'agent' QUALIFY row_number() OVER (PARTITION BY external_id
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, price_kzt DESC) = 1),
new AS (SELECT * FROM rows WHERE posted_by = 'owner' QUALIFY row_number() OVER (PARTITION BY external_id
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, price_kzt DESC) = 1)
"""


def s7(v):
    """Upsert where every fifth scraped row claims a neighbour's url."""
    old, new, order = _stored(v)
    line = F.split("external_id", "-")
    stolen = F.concat_ws("/", F.lit("https://example.com/a/show"), line[0], F.lit("1"))
    new = new.withColumn("url", F.when(F.col("l_partkey") % 5 == 0, stolen).otherwise(F.col("url")))
    snapshot, rejects = st.upsert_listings(old, new, order)
    return (
        snapshot.select("external_id", "url", F.lit("stored").alias("fate"))
        .unionByName(rejects.select("external_id", "url", F.lit("rejected").alias("fate")))
    )


S7_BODY = """
, claim AS (SELECT external_id, CASE WHEN l_partkey % 5 = 0 THEN 'https://example.com/a/show/' || l_orderkey || '/1'
  ELSE 'https://example.com/a/show/' || l_orderkey || '/' || l_linenumber END AS url FROM new),
kept AS (SELECT external_id, 'https://example.com/a/show/' || l_orderkey || '/' || l_linenumber AS url FROM old),
held AS (SELECT k.* FROM kept k LEFT JOIN claim c USING (external_id) WHERE c.external_id IS NULL OR c.url = k.url),
owner AS (SELECT url, arg_min(external_id, (late, external_id)) AS who FROM (
  SELECT url, external_id, 1 AS late FROM claim UNION ALL SELECT url, external_id, 0 FROM held) GROUP BY url),
good AS (SELECT c.* FROM claim c JOIN owner o ON c.url = o.url AND o.who = c.external_id)
SELECT external_id, url, 'stored' AS fate FROM good
UNION ALL SELECT k.external_id, k.url, 'stored' FROM kept k WHERE k.external_id NOT IN (SELECT external_id FROM good)
UNION ALL SELECT c.external_id, c.url, 'rejected' FROM claim c WHERE c.external_id NOT IN (SELECT external_id FROM good)
"""


def _criteria_rows(v):
    return v.table("orders").select(
        F.col("o_orderkey").alias("criteria_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        F.floor("o_totalprice").cast("bigint").alias("max_price_kzt"), "o_orderstatus",
    )


def s4(v):
    rows = _criteria_rows(v)
    old = rows.where(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    new = rows.where(F.col("o_orderstatus") != "F").drop("o_orderstatus")
    return st.replace_criteria(old, new, ["created_at", "criteria_id"]).select(
        "criteria_id", "user_id", "max_price_kzt"
    )


def s5(v):
    return st.active_criteria(_criteria_rows(v), v.users).select("user_id", "criteria_id", "max_price_kzt")


def s8(v):
    users = v.table("customer").select(
        F.col("c_custkey").alias("telegram_user_id"), F.col("c_name").alias("username")
    )
    new = v.table("orders").select(
        (F.col("o_custkey") * 2).alias("telegram_user_id"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("u"), F.col("o_orderkey"))).alias("username"),
        "o_orderdate", "o_orderkey",
    )
    return st.upsert_users(users, new, ["o_orderdate", "o_orderkey"])


def s9(v):
    new = v.table("orders").select(
        (F.col("o_custkey") * 2).alias("user_id"),
        F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False).alias("is_enabled"),
        F.when(F.col("o_orderkey") % 2 == 0, 60 * (F.col("o_orderkey") % 5 + 1)).cast("int").alias("interval_minutes"),
        F.lit(None).cast("timestamp").alias("last_checked_at"),
        "o_orderdate", "o_orderkey",
    )
    return st.upsert_monitor_settings(v.monitors, new, ["o_orderdate", "o_orderkey"]).select(
        "user_id", "is_enabled", "interval_minutes", text_ts("last_checked_at")
    )


def s6(v):
    body = F.struct(F.col("p_partkey").alias("listing_id"), F.col("p_size").alias("rooms"),
                    F.floor("p_retailprice").cast("bigint").alias("price_kzt"))
    nested = F.to_json(F.struct(body.alias("apartment"), (F.col("p_partkey") % 9).alias("nearby_schools")))
    payload = F.when(F.col("p_partkey") % 2 == 0, nested).otherwise(F.to_json(body))
    rows = v.table("part").select(
        st.decode_payload(payload, "struct<listing_id:bigint,rooms:int,price_kzt:bigint>", "nearby_schools:int").alias("d")
    )
    return rows.select("d.apartment.listing_id", "d.apartment.rooms", "d.apartment.price_kzt",
                       F.col("d.enriched.nearby_schools").alias("nearby_schools"))


KNOWN_EVENTS = """, known AS (SELECT d.user_id, d.listing_id * 25 AS listing_id, d.ts, d.seq, d.op FROM v_decisions d
  WHERE d.listing_id * 25 IN (SELECT listing_id FROM v_decided_listings))
"""


CHECKS = {
    "E1_save_reject_upsert": (
        e1,
        sql(
            f"""SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.listing_id, o.listing_id) AS listing_id,
  coalesce(n.decision, 'saved') AS decision,
  strftime(coalesce(n.decided_at, o.at), '%Y-%m-%d %H:%M:%S.%f') AS decided_at,
  CASE WHEN n.user_id IS NULL THEN strftime(o.at, '%Y-%m-%d %H:%M:%S.%f') END AS deleted_at, page_id
FROM (SELECT user_id, listing_id, CASE op WHEN 'save' THEN 'saved' ELSE 'rejected' END AS decision, ts AS decided_at
  FROM v_decisions WHERE op IN ('save', 'reject')
  QUALIFY row_number() OVER (PARTITION BY user_id, listing_id ORDER BY ts DESC) = 1) n
FULL JOIN (SELECT user_id, listing_id, min(ts) AS at, 'page-' || min(seq) AS page_id FROM v_decisions
  WHERE op = 'delete_saved' GROUP BY ALL) o ON n.user_id = o.user_id AND n.listing_id = o.listing_id""",
            "v_decisions",
        ),
    ),
    "E2_delete_saved": (
        e2,
        fold_sql(
            f"SELECT user_id, listing_id, {sql_ts('deleted_at')} FROM feedback WHERE decision = 'saved' AND deleted_at IS NOT NULL",
        ),
    ),
    "E3_restore": (
        e3,
        fold_sql(
            f"SELECT user_id, listing_id, {sql_ts('decided_at')}, {sql_ts('deleted_at')} FROM feedback",
        ),
    ),
    "E4_unreject": (
        e4,
        fold_sql(
            f"SELECT user_id, listing_id, {sql_ts('decided_at')} FROM feedback WHERE decision = 'rejected' AND deleted_at IS NULL",
        ),
    ),
    "E5_purge_forever": (
        e5,
        fold_sql(f"SELECT user_id, listing_id, {sql_ts('deleted_at')} FROM feedback WHERE decision = 'rejected' AND deleted_at IS NOT NULL"),
    ),
    "E6_mark_seen": (
        e6,
        sql(
            """SELECT user_id, count(*) AS n, CAST(sum(listing_id) AS BIGINT) AS total FROM (
  SELECT user_id, listing_id FROM v_decisions EXCEPT SELECT user_id, listing_id FROM v_decisions WHERE op = 'purge') GROUP BY 1""",
            "v_decisions",
        ),
    ),
    "E7_unknown_listing": (
        e7,
        fold_sql("SELECT user_id, listing_id, decision FROM feedback", "v_decided_listings", events="known", extra=KNOWN_EVENTS),
    ),
    "E_feedback_fold": (fold_out, fold_sql(f"SELECT {FOLD_COLS} FROM feedback")),
    "L9_listings_by_request": (
        l9,
        sql(
            """SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY first_at) - 1 AS pos, key AS listing_id, city
FROM (SELECT l_orderkey AS request_id, l_partkey * 2 AS key, min((l_linenumber, l_partkey, l_suppkey)) AS first_at
  FROM lineitem GROUP BY ALL) LEFT JOIN v_decided_listings ON listing_id = key QUALIFY city IS NOT NULL""",
            "v_decided_listings",
        ),
    ),
    "L10_hide_decided": (
        l10,
        fold_sql(
            """SELECT user_id, count(*) AS n, CAST(sum(listing_id) AS BIGINT) AS total FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM feedback f WHERE f.user_id = p.user_id AND f.listing_id = p.listing_id) GROUP BY 1""",
            extra=PAIRS_SQL,
        ),
    ),
    "L11_unseen": (
        l11,
        sql(
            """WITH pairs AS (SELECT o_custkey % 150 AS user_id, l_partkey % 100 AS listing_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT user_id, count(*) AS n, CAST(sum(listing_id) AS BIGINT) AS total FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM v_decisions f WHERE f.op = 'purge' AND f.user_id = p.user_id AND f.listing_id = p.listing_id)
GROUP BY 1""",
            "v_decisions",
        ),
    ),
    "L12_feedback_listings": (
        l12,
        fold_sql(
            """SELECT telegram_user_id, listing_id, decision, city, price_kzt FROM feedback JOIN v_users USING (user_id)
JOIN v_decided_listings USING (listing_id) WHERE deleted_at IS NULL""",
            "v_users", "v_decided_listings",
        ),
    ),
    "A2_count_active_feedback": (
        a2,
        fold_sql("SELECT user_id, decision, count(*) AS n FROM feedback WHERE deleted_at IS NULL GROUP BY ALL"),
    ),
    "U1_trash_list": (
        u1,
        fold_sql(
            f"""SELECT user_id, listing_id, part, strftime(shown, '%Y-%m-%d %H:%M:%S.%f') AS shown_at, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part, shown DESC, listing_id) AS rank FROM (
    SELECT user_id, listing_id, 0 AS part, decided_at AS shown FROM feedback WHERE decision = 'rejected' AND deleted_at IS NULL
    UNION ALL SELECT user_id, listing_id, 1, deleted_at FROM feedback WHERE decision = 'saved' AND deleted_at IS NOT NULL))
WHERE rank <= 10"""
        ),
    ),
    "U2_liked_minus_disliked": (
        u2,
        fold_sql(
            """SELECT user_id, coalesce(string_agg(DISTINCT district, ',' ORDER BY district) FILTER (decision = 'saved'), '') AS liked,
  coalesce(string_agg(DISTINCT district, ',' ORDER BY district) FILTER (decision = 'rejected' AND district NOT IN (
    SELECT district FROM feedback g JOIN v_decided_listings USING (listing_id)
    WHERE g.user_id = a.user_id AND g.decision = 'saved' AND g.deleted_at IS NULL)), '') AS disliked
FROM (SELECT * FROM feedback JOIN v_decided_listings USING (listing_id) WHERE deleted_at IS NULL) a GROUP BY user_id""",
            "v_decided_listings",
        ),
    ),
    "W11_newest_lists": (w11, fold_sql(W11_SQL)),
    "W1_upsert_last_wins": (
        w1,
        None,
    ),
    "S7_listing_upsert": (s7, None),
    "S4_replace_criteria": (
        s4,
        """WITH fresh AS (SELECT * FROM orders WHERE o_orderstatus <> 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_orderkey AS criteria_id, o_custkey AS user_id, CAST(floor(o_totalprice) AS BIGINT) AS max_price_kzt FROM fresh
UNION ALL SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) FROM orders
WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM fresh)""",
    ),
    "S5_active_criteria": (
        s5,
        """SELECT o_custkey AS user_id, o_orderkey AS criteria_id, CAST(floor(o_totalprice) AS BIGINT) AS max_price_kzt
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    ),
    "S6_payload_decode": (
        s6,
        """SELECT p_partkey AS listing_id, p_size AS rooms, CAST(floor(p_retailprice) AS BIGINT) AS price_kzt,
  CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 9 END AS nearby_schools FROM part""",
    ),
    "S8_user_upsert": (
        s8,
        """WITH n AS (SELECT o_custkey * 2 AS id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'u' || o_orderkey END AS name
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT coalesce(n.id, c_custkey) AS telegram_user_id, CASE WHEN n.id IS NULL THEN c_name ELSE n.name END AS username
FROM customer FULL JOIN n ON n.id = c_custkey""",
    ),
    "S9_monitor_settings_upsert": (
        s9,
        sql(
            f"""WITH n AS (SELECT o_custkey * 2 AS id,
  arg_max(o_orderstatus = 'O', (o_orderdate, o_orderkey)) FILTER (o_orderstatus IN ('O', 'F')) AS on_,
  arg_max(60 * (o_orderkey % 5 + 1), (o_orderdate, o_orderkey)) FILTER (o_orderkey % 2 = 0) AS mins FROM orders GROUP BY 1)
SELECT coalesce(n.id, user_id) AS user_id, coalesce(on_, is_enabled, false) AS is_enabled,
  coalesce(mins, interval_minutes, 360) AS interval_minutes, {sql_ts('last_checked_at')}
FROM v_monitors FULL JOIN n ON n.id = user_id""",
            "v_monitors",
        ),
    ),
}


def _stored_sql(body: str) -> str:
    base = sql("SELECT 1", "v_listings")
    return base[: base.rindex("SELECT 1")] + STORED_SQL.strip() + body


CHECKS["W1_upsert_last_wins"] = (
    w1,
    _stored_sql(
        f"""
SELECT coalesce(n.external_id, o.external_id) AS external_id, coalesce(n.price_kzt, o.price_kzt) AS price_kzt,
  strftime(coalesce(o.published_at, n.published_at), '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM old o FULL JOIN new n ON n.external_id = o.external_id"""
    ),
)
CHECKS["S7_listing_upsert"] = (s7, _stored_sql(S7_BODY))
