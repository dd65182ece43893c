"""Upserts, the decision life cycle, and the lists read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.functions import text as tx
from kvartal.operators.skew import carry_last

LIST_LIMIT = 10


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key (two-phase, so a hot key is pre-reduced).

    Order columns lead the row, so they travel once; of equal rows the greater rest is taken.
    A map has no order: rows with one are carried beside their order.
    """
    rest = [c for c in rows.columns if c not in keys]
    if any("map<" in kind for _, kind in rows.select(*rest).dtypes) or not set(order) <= set(rest):
        last = F.max_by(F.struct(*rest), F.struct(*order))
    else:
        last = F.max(F.struct(*order, *[c for c in rest if c not in order]))
    best = rows.groupBy(*keys).agg(last.alias("__row"))
    return best.select(*keys, "__row.*").select(*rows.columns)


def merge(
    current: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep: Sequence[str] = (),
    only_known: Sequence[str] = (),
) -> DataFrame:
    """Snapshot after an upsert: the last incoming row per key wins.

    ``keep`` columns stay as they are once a row exists; ``only_known`` columns
    are overwritten by non-null values only, each by its own last known value.
    """
    columns = current.columns
    rest = [c for c in columns if c not in keys]
    rank = F.struct(*order)
    picks = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"__n_{c}")
        if c in only_known
        else F.max_by(F.col(c), rank).alias(f"__n_{c}")
        for c in rest
    ]
    new = incoming.groupBy(*keys).agg(*picks)
    return _overlaid(current, new, keys, keep, only_known)


def _overlaid(
    current: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), only_known: Sequence[str] = ()
) -> DataFrame:
    """Snapshot under ``new`` rows (columns ``__n_...``), of which a key has one at most."""
    columns = current.columns
    rest = [c for c in columns if c not in keys]
    new = new.withColumn("__new", F.lit(True))
    old = current.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in rest], F.lit(True).alias("__old"))
    both = old.join(new, list(keys), "full_outer")

    def value(c: str) -> Column:
        o, n = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        if c in keep:
            return F.when(F.col("__old").isNotNull(), o).otherwise(n)
        if c in only_known:
            return F.coalesce(n, o)
        return F.when(F.col("__new").isNotNull(), n).otherwise(o)

    return both.select(*keys, *[value(c).alias(c) for c in rest]).select(*columns)


def upsert_users(users: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    clean = incoming.withColumn("username", tx.blank_to_null("username"))
    return merge(users, clean, ["telegram_user_id"], order)


def upsert_monitor_settings(settings: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """Only given values overwrite; a new row starts disabled with six hours."""
    merged = merge(
        settings, incoming, ["user_id"], order, only_known=["is_enabled", "interval_minutes"],
        keep=["last_checked_at"],
    )
    return merged.withColumns(
        {
            "is_enabled": F.coalesce("is_enabled", F.lit(False)),
            "interval_minutes": F.coalesce("interval_minutes", F.lit(360)),
        }
    )


def upsert_listings(current: DataFrame, incoming: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(snapshot, rejects) after an upsert keyed by (source, external_id).

    ``created_at`` survives. A url is unique too: an incoming row whose url
    belongs to another listing, stored or incoming, is rejected; of several
    incoming claimants the smallest key is taken.
    """
    key = ["source", "external_id"]
    fresh = last_per_key(incoming, key, order)
    identity = F.struct(*key)
    stored = current.select("url", identity.alias("__holder"))
    replaced = current.join(fresh.select(*key, F.col("url").alias("__url")), key, "inner").where(
        F.col("url") != F.col("__url")
    )
    freed = replaced.select("url", identity.alias("__holder"))
    held = stored.join(freed, ["url", "__holder"], "left_anti")
    owners = (
        fresh.select("url", identity.alias("__who"), F.lit(1).alias("__late"))
        .unionByName(held.select("url", F.col("__holder").alias("__who"), F.lit(0).alias("__late")))
        .groupBy("url")
        .agg(F.min(F.struct("__late", "__who")).alias("__first"))
        .select("url", F.col("__first.__who").alias("__who"))
    )
    judged = fresh.join(owners, "url", "left")
    good = judged.where(F.col("__who") == identity).drop("__who")
    rejects = judged.where(F.col("__who") != identity).drop("__who")
    # a key is left with one row, so there is no last one to look for
    rows = good.select(*key, *[F.col(c).alias(f"__n_{c}") for c in current.columns if c not in key])
    snapshot = _overlaid(current, rows, key, keep=["created_at"])
    return snapshot, rejects.select(*incoming.columns)


def replace_criteria(current: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """A user has one criteria row: the newest incoming one replaces all old."""
    fresh = last_per_key(incoming, ["user_id"], order)
    kept = current.join(fresh.select("user_id"), "user_id", "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def active_criteria(criteria: DataFrame, users: DataFrame) -> DataFrame:
    """The newest active criteria of every known user."""
    live = criteria.where(F.col("is_active")).join(users.select("user_id"), "user_id", "left_semi")
    return last_per_key(live, ["user_id"], ["created_at", "criteria_id"])


# --- decision life cycle -----------------------------------------------------

SETS = ("save", "reject")


def known_only(events: DataFrame, listings: DataFrame) -> DataFrame:
    """A decision about an unknown listing does nothing."""
    return events.join(listings.select("listing_id").distinct(), "listing_id", "left_semi")


def feedback_state(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Decision rows left by an event log (user_id, listing_id, ts, seq, op).

    Save and reject set the state whatever it was, so only what follows the last
    of them matters. After a save, purge acts only when the last delete or
    restore before it was a delete; after a reject the first restore or purge
    decides. Each is a look-up of an earlier event, no row-by-row replay.

    Columns: decision (saved or rejected), decided_at, deleted_at (null while
    active). A pair without a row has no decision.
    """
    chunk = F.date_trunc("day", F.col("ts")) if chunk is None else chunk
    keys = ["user_id", "listing_id"]
    at = F.struct("ts", "seq")
    base = (
        events.where(F.col("op").isin(*SETS))
        .groupBy(*keys)
        .agg(F.max(at).alias("base_at"), F.max_by("op", at).alias("base"))
    )
    later = events.where(~F.col("op").isin(*SETS)).join(base, keys, "inner").where(at > F.col("base_at"))
    op = F.col("op")
    mark = F.when(op == "delete_saved", F.lit(1)).when(op == "restore", F.lit(0))
    later = carry_last(later, keys, ["ts", "seq"], {"before": mark}, chunk, inclusive=False)
    in_trash = F.coalesce(F.col("before") == 1, F.lit(False))
    saved = F.col("base") == "save"
    tail = later.groupBy(*keys).agg(
        F.max(saved & (op == "purge") & in_trash).alias("gone"),
        F.max(F.when(op == "purge", F.col("ts"))).alias("purge_ts"),
        F.max_by(mark, F.when(mark.isNotNull(), at)).alias("last_mark"),
        F.max(F.when((op == "delete_saved") & ~in_trash, F.col("ts"))).alias("trash_ts"),
        F.min_by(op, F.when(op != "delete_saved", at)).alias("first_op"),
    )
    state = base.join(tail, keys, "left")
    gone = F.coalesce(F.col("gone"), F.lit(False))
    first = F.coalesce(F.col("first_op"), F.lit(""))
    return state.where(saved | (first != "restore")).select(
        *keys,
        F.when(saved & ~gone, F.lit("saved")).otherwise(F.lit("rejected")).alias("decision"),
        F.col("base_at.ts").alias("decided_at"),
        F.when(saved & gone, F.col("purge_ts"))
        .when(saved, F.when(F.col("last_mark") == 1, F.col("trash_ts")))
        .otherwise(F.when(first == "purge", F.col("purge_ts")))
        .alias("deleted_at"),
    )


def apply_decisions(
    current: DataFrame, rows: DataFrame, keep: Sequence[str] = ("page_id", "synced_at")
) -> DataFrame:
    """One bulk save or reject on a feedback snapshot; export ids survive."""
    return merge(current, rows, ["user_id", "listing_id"], ["decided_at"], keep=keep)


def active(feedback: DataFrame, decision: str) -> DataFrame:
    return feedback.where((F.col("decision") == decision) & F.col("deleted_at").isNull())


def trashed(feedback: DataFrame) -> DataFrame:
    return feedback.where((F.col("decision") == "saved") & F.col("deleted_at").isNotNull())


def count_active(feedback: DataFrame) -> DataFrame:
    live = feedback.where(F.col("deleted_at").isNull())
    return live.groupBy("user_id", "decision").agg(F.count(F.lit(1)).alias("n"))


def newest(rows: DataFrame, when: str, tie: str = "listing_id", limit: int = LIST_LIMIT) -> DataFrame:
    """Newest rows of every user, at most ``limit``; adds ``rank``."""
    w = Window.partitionBy("user_id").orderBy(F.col(when).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def trash_list(feedback: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """Rejected first, then deleted from saved, newest first, cut to ``limit``."""
    cols = ["user_id", "listing_id", "part", "at"]
    rejected = active(feedback, "rejected").select(
        "user_id", "listing_id", F.lit(0).alias("part"), F.col("decided_at").alias("at")
    )
    deleted = trashed(feedback).select(
        "user_id", "listing_id", F.lit(1).alias("part"), F.col("deleted_at").alias("at")
    )
    w = Window.partitionBy("user_id").orderBy("part", F.col("at").desc(), "listing_id")
    both = rejected.unionByName(deleted)
    return both.select(*cols, F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)


def feedback_listings(feedback: DataFrame, users: DataFrame, listings: DataFrame) -> DataFrame:
    """Active decisions with the user and the listing."""
    live = feedback.where(F.col("deleted_at").isNull())
    return live.join(users, "user_id").join(listings, "listing_id")


def hide_decided(pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Drop candidates the user ever decided on, trash and tombstones included."""
    return pairs.join(feedback.select("user_id", "listing_id"), ["user_id", "listing_id"], "left_anti")


def unseen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    return pairs.join(seen.select("user_id", "listing_id"), ["user_id", "listing_id"], "left_anti")


def mark_seen(pairs: DataFrame, seen: DataFrame, at: Column) -> DataFrame:
    """Rows to append to ``seen``: each new pair once."""
    new = unseen(pairs.select("user_id", "listing_id"), seen)
    return new.distinct().withColumn("first_seen_at", at)


def by_request_order(keys: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """Listings by key in request order, each once.

    ``keys`` has request_id and an array column ``keys``.
    """
    asked = keys.select("request_id", F.posexplode(F.array_distinct("keys")).alias("pos", key))
    return asked.join(listings, key, "inner")


def decode_payload(payload: Column | str, apartment_type: str, extra_type: str) -> Column:
    """Stored JSON in either shape: an enriched object or a bare apartment."""
    p = tx.col(payload)
    enriched = F.from_json(p, f"struct<apartment:{apartment_type},{extra_type}>")
    bare = F.from_json(p, apartment_type)
    nested = F.get_json_object(p, "$.apartment").isNotNull()
    return F.struct(F.when(nested, enriched["apartment"]).otherwise(bare).alias("apartment"),
                    F.when(nested, enriched).alias("enriched"))
