"""Decision events as maps of states: outcome per event, and a snapshot carried on by new events.

A (user, listing) pair is in one of STATES. An event maps every state to the next one, and
maps compose, so a stretch of events is one map. Events are put into blocks of BLOCK in
order of time; a block becomes one map where it lies, the maps of a pair's blocks give the
state before each block, and every block then tells the state before each of its events.
Only one number per block meets in one place, so a pair of a third of all events is worked
on in many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("none", "saved", "trashed", "rejected", "gone")
NONE, SAVED, TRASHED, REJECTED, GONE = range(len(STATES))
#: The state after an event, for each state before it.
MOVES = {
    "save": (SAVED,) * 5,
    "reject": (REJECTED,) * 5,
    "delete_saved": (NONE, TRASHED, TRASHED, REJECTED, GONE),
    "restore": (NONE, SAVED, SAVED, NONE, GONE),
    "purge": (NONE, SAVED, GONE, GONE, GONE),
}
#: Events of a block.
BLOCK = 256
KEYS = ("user_id", "listing_id")
_BITS = 3


def _packed(states: Sequence[int]) -> int:
    """A map as one number, _BITS per state."""
    return sum(after << (_BITS * before) for before, after in enumerate(states))


_STAY = _packed(range(len(STATES)))


def _move(op: Column) -> Column:
    out = F.lit(_STAY)
    for name, states in MOVES.items():
        out = F.when(op == name, F.lit(_packed(states))).otherwise(out)
    return out


def _after(move: Column, state: Column) -> Column:
    return F.call_function("shiftright", move, state * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))


def _then(first: Column, second: Column) -> Column:
    """The map of one stretch of events followed by another."""
    parts = [F.shiftleft(_after(second, _after(first, F.lit(s))), _BITS * s) for s in range(len(STATES))]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def _befores(start: Column, moves: Column) -> Column:
    """The state before each of an array's maps."""
    zero = F.struct(start.alias("state"), F.array().cast("array<int>").alias("before"))
    scan = F.aggregate(
        moves,
        zero,
        lambda acc, m: F.struct(_after(m, acc["state"]).alias("state"), F.array_append(acc["before"], acc["state"]).alias("before")),
    )
    return scan["before"]


def state_of(decision: Column, deleted_at: Column) -> Column:
    """State of a stored decision row."""
    saved, live = decision == "saved", deleted_at.isNull()
    return F.when(saved & live, SAVED).when(saved, TRASHED).when(live, REJECTED).otherwise(GONE)


def with_states(events: DataFrame, snapshot: DataFrame | None = None, chunk: Column | None = None) -> DataFrame:
    """``events`` with the states before and after each (columns before and after, numbers of STATES).

    Events: user_id, listing_id, ts, seq, op and any others that can be sorted. ``snapshot`` holds the decision
    rows from which the events go on. ``chunk`` must rise with ts (a day by default). Events
    of another op than those of MOVES change nothing.
    """
    chunk = F.date_trunc("day", F.col("ts")) if chunk is None else chunk
    at = [F.col(k) for k in KEYS]
    order = Window.partitionBy(*KEYS, "chunk").orderBy("event.ts", "event.seq")
    rows = events.select(*at, chunk.alias("chunk"), F.struct("*").alias("event")).withColumn("n", F.row_number().over(order) - 1)
    rows = rows.select(*KEYS, "chunk", F.floor(F.col("n") / BLOCK).alias("block"), "n", _move(F.col("event.op")).alias("move"), "event")
    blocks = rows.groupBy(*KEYS, "chunk", "block").agg(F.sort_array(F.collect_list(F.struct("n", "move", "event"))).alias("events"))
    blocks = blocks.withColumn("move", F.aggregate("events", F.lit(_STAY), lambda acc, e: _then(acc, e["move"])))

    pairs = blocks.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("chunk", "block", "move"))).alias("blocks"))
    if snapshot is None:
        start = F.lit(NONE)
    else:
        # only rows of pairs with events; few of them are sent to the snapshot, not the other way round
        known = snapshot.select(*KEYS, state_of(F.col("decision"), F.col("deleted_at")).alias("start"))
        known = known.join(events.select(*KEYS).distinct(), list(KEYS), "left_semi")
        pairs = pairs.join(known, list(KEYS), "left")
        start = F.coalesce("start", F.lit(NONE))
    befores = _befores(start, F.transform("blocks", lambda b: b["move"]))
    starts = pairs.select(*KEYS, F.explode(F.arrays_zip(F.col("blocks"), befores.alias("state"))).alias("b")).select(
        *KEYS, "b.blocks.chunk", F.struct("b.blocks.block", "b.state").alias("start")
    )
    starts = starts.groupBy(*KEYS, "chunk").agg(F.map_from_entries(F.collect_list("start")).alias("starts"))
    told = blocks.join(starts, [*KEYS, "chunk"])
    inside = _befores(F.element_at("starts", F.col("block")), F.transform("events", lambda e: e["move"]))
    told = told.select(F.explode(F.arrays_zip(F.col("events"), inside.alias("before"))).alias("e"))
    before = F.col("e.before")
    return told.select("e.events.event.*", before.alias("before"), _after(F.col("e.events.move"), before).alias("after"))


def outcomes(
    events: DataFrame, listings: DataFrame, snapshot: DataFrame | None = None, chunk: Column | None = None
) -> DataFrame:
    """``events`` with before, after, outcome and affected (rows that the event changed, 1 or 0).

    Outcomes: recorded (save, reject), deleted, restored_to_saved, unrejected, purged,
    nothing, and unknown_listing for what ``listings`` (listing_id) doesn't hold; such an event
    changes nothing and reports 0.
    """
    known = listings.select("listing_id").distinct().withColumn("known", F.lit(True))
    marked = events.join(known, "listing_id", "left")
    op = F.col("op")
    marked = marked.withColumns({"op": F.when(F.col("known"), op), "asked": op})
    told = with_states(marked, snapshot, chunk)
    before = F.col("before")
    outcome = (
        F.when(F.col("known").isNull(), "unknown_listing")
        .when(op.isin("save", "reject"), "recorded")
        .when((op == "delete_saved") & (before == SAVED), "deleted")
        .when((op == "restore") & (before == TRASHED), "restored_to_saved")
        .when((op == "restore") & (before == REJECTED), "unrejected")
        .when((op == "purge") & before.isin(TRASHED, REJECTED, GONE), "purged")
        .otherwise("nothing")
    )
    told = told.withColumn("outcome", outcome).withColumn("op", F.col("asked")).drop("asked", "known")
    return told.withColumn("affected", (~F.col("outcome").isin("nothing", "unknown_listing")).cast("int"))


def fold(snapshot: DataFrame, events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """The decision rows after ``events``; other columns of ``snapshot`` stay with their pair."""
    told = with_states(events, snapshot, chunk)
    op, before, after, ts = (F.col(c) for c in ("op", "before", "after", "ts"))
    # the last entry into a state is what its time stands for; a repeated purge renews it
    changed = told.groupBy(*KEYS).agg(
        F.max_by("after", F.struct("ts", "seq")).alias("state"),
        F.max(F.when(op.isin("save", "reject"), ts)).alias("based_at"),
        F.max(F.when((before == SAVED) & (after == TRASHED), ts)).alias("trashed_at"),
        F.max(F.when((op == "purge") & (after == GONE), ts)).alias("gone_at"),
    )
    rest = [c for c in snapshot.columns if c not in (*KEYS, "decision", "decided_at", "deleted_at")]
    both = snapshot.join(changed, list(KEYS), "full_outer")
    state = F.coalesce("state", state_of(F.col("decision"), F.col("deleted_at")))
    deleted = F.when(state == TRASHED, F.coalesce("trashed_at", "deleted_at")).when(state == GONE, F.coalesce("gone_at", "deleted_at"))
    return both.where(state != NONE).select(
        *KEYS,
        F.when(state.isin(SAVED, TRASHED), "saved").otherwise("rejected").alias("decision"),
        F.coalesce("based_at", "decided_at").alias("decided_at"),
        deleted.alias("deleted_at"),
        *rest,
    )
