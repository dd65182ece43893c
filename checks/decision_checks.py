"""Decision events with their outcomes, and snapshots carried on by later events."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.state_checks import FOLD_COLS, KNOWN_EVENTS, fold_sql, text_ts
from kvartal.operators import decisions as de
from kvartal.operators import state as st

#: Events before it make the snapshot, the others are folded into it.
CUT = "2024-01-19 12:00:00"


def _widened(v):
    """Decisions of which only some listings are known."""
    return v.decisions.withColumn("listing_id", F.col("listing_id") * 25)


def outcomes(v):
    """What every event of the log did."""
    every = v.decisions.select("listing_id").distinct()
    return de.outcomes(v.decisions, every).select("seq", "op", "outcome", "affected")


def e3_outcomes(v):
    every = v.decisions.select("listing_id").distinct()
    told = de.outcomes(v.decisions, every).where(F.col("op") == "restore")
    return told.select("user_id", "listing_id", "seq", "outcome")


def e7_outcomes(v):
    """Rows affected by each user's events, with those about unknown listings."""
    told = de.outcomes(_widened(v), v.decided_listings)
    return told.groupBy("user_id", "op", "outcome").agg(
        F.count("*").alias("n"), F.sum("affected").alias("affected")
    )


def e_incremental_fold(v):
    """A snapshot of the first events, then the others on top of it."""
    early = F.col("ts") < F.lit(CUT).cast("timestamp")
    snapshot = st.feedback_state(v.decisions.where(early)).withColumn("page_id", F.lit(None).cast("string"))
    return de.fold(snapshot, v.decisions.where(~early)).select(
        "user_id", "listing_id", "decision", text_ts("decided_at"), text_ts("deleted_at")
    )


def e_incremental_outcomes(v):
    """Outcomes of the later events, told from the snapshot and not from the log."""
    early = F.col("ts") < F.lit(CUT).cast("timestamp")
    snapshot = st.feedback_state(v.decisions.where(early))
    every = v.decisions.select("listing_id").distinct()
    return de.outcomes(v.decisions.where(~early), every, snapshot).select("seq", "op", "outcome", "affected")


OUTCOME_SQL = """CASE WHEN e.op IN ('save', 'reject') THEN 'recorded'
  WHEN e.op = 'delete_saved' AND f.state = 'saved' THEN 'deleted'
  WHEN e.op = 'restore' AND f.state = 'trashed' THEN 'restored_to_saved'
  WHEN e.op = 'restore' AND f.state = 'rejected' THEN 'unrejected'
  WHEN e.op = 'purge' AND f.state IN ('trashed', 'rejected', 'gone') THEN 'purged' ELSE 'nothing' END"""
TOLD_SQL = f""", told AS (SELECT e.*, {OUTCOME_SQL} AS outcome
  FROM ev e JOIN fold f ON e.user_id = f.user_id AND e.listing_id = f.listing_id AND e.n = f.n + 1)
"""


def _told(body: str, **more) -> str:
    text = fold_sql("@", *more.pop("names", ()), **more)
    return text.replace("@", TOLD_SQL + body)


AFFECTED = "CAST(outcome NOT IN ('nothing', 'unknown_listing') AS INTEGER) AS affected"

CHECKS = {
    "E_outcomes": (outcomes, _told(f"SELECT seq, op, outcome, {AFFECTED} FROM told")),
    "E3_outcomes": (e3_outcomes, _told("SELECT user_id, listing_id, seq, outcome FROM told WHERE op = 'restore'")),
    "E7_outcomes": (
        e7_outcomes,
        _told(
            """SELECT user_id, op, outcome, count(*) AS n, CAST(sum(CAST(outcome NOT IN ('nothing', 'unknown_listing') AS INTEGER)) AS BIGINT) AS affected
FROM (SELECT user_id, op, outcome FROM told UNION ALL SELECT user_id, op, 'unknown_listing' FROM v_decisions
  WHERE listing_id * 25 NOT IN (SELECT listing_id FROM v_decided_listings)) GROUP BY 1, 2, 3""",
            names=("v_decided_listings",), events="known", extra=KNOWN_EVENTS,
        ),
    ),
    "E_incremental_fold": (e_incremental_fold, fold_sql(f"SELECT {FOLD_COLS} FROM feedback")),
    "E_incremental_outcomes": (
        e_incremental_outcomes, _told(f"SELECT seq, op, outcome, {AFFECTED} FROM told WHERE ts >= TIMESTAMP '{CUT}'"),
    ),
}
