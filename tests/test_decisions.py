"""Outcomes and incremental folds against a plain replay of random logs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kvartal.operators import decisions as de

START = dt.datetime(2026, 1, 1)
SCHEMA = "user_id long, listing_id long, ts timestamp, seq long, op string, event string"
OPS = ["save", "reject", "delete_saved", "restore", "purge", "purge", "delete_saved", "other", None]


def replay(events, known, start=None):
    """(outcome per seq, final row per pair) of events in order."""
    rows, told = dict(start or {}), {}
    for user, listing, ts, seq, op, _ in events:
        key = (user, listing)
        decision, decided, deleted = rows.get(key, (None, None, None))
        outcome = "nothing"
        if listing not in known:
            outcome = "unknown_listing"
        elif op in ("save", "reject"):
            rows[key] = ("saved" if op == "save" else "rejected", ts, None)
            outcome = "recorded"
        elif op == "delete_saved" and decision == "saved" and deleted is None:
            rows[key] = (decision, decided, ts)
            outcome = "deleted"
        elif op == "restore" and decision == "saved" and deleted is not None:
            rows[key] = (decision, decided, None)
            outcome = "restored_to_saved"
        elif op == "restore" and decision == "rejected" and deleted is None:
            del rows[key]
            outcome = "unrejected"
        elif op == "purge" and decision is not None and (deleted is not None or decision == "rejected"):
            rows[key] = ("rejected", decided, ts)
            outcome = "purged"
        told[seq] = outcome
    return told, rows


def log(seed, n=3000):
    """A third of all events belong to one pair; ties in time are broken by seq."""
    rnd = random.Random(seed)
    return [
        (*((1, 1) if rnd.random() < 0.33 else (rnd.randrange(20), rnd.randrange(20))),
         START + dt.timedelta(hours=seq // 3), seq, rnd.choice(OPS), f"e{seq}")
        for seq in range(n)
    ]


def snapshot_of(spark, rows):
    data = [(*k, *v, f"page{k[1]}") for k, v in rows.items()]
    return spark.createDataFrame(
        data, "user_id long, listing_id long, decision string, decided_at timestamp, deleted_at timestamp, page_id string"
    )


@pytest.mark.parametrize("block", [256, 5])
def test_outcomes_equal_replay(spark, monkeypatch, block):
    monkeypatch.setattr(de, "BLOCK", block)
    events = log(3)
    known = set(range(15))
    listings = spark.createDataFrame([(i,) for i in [*known, *known, 99]], "listing_id long")
    df = spark.createDataFrame(events, SCHEMA).repartition(7)
    rows = de.outcomes(df, listings).collect()
    want, _ = replay(events, known)
    assert {r.seq: r.outcome for r in rows} == want and len(rows) == len(events)
    assert {r.seq: (r.op, r.event) for r in rows} == {e[3]: (e[4], e[5]) for e in events}
    assert sum(r.affected for r in rows) == sum(o not in ("nothing", "unknown_listing") for o in want.values())
    one = de.outcomes(df, listings, chunk=F.lit(0)).select("seq", "outcome").collect()  # no cut by time at all
    assert {r.seq: r.outcome for r in one} == want


@pytest.mark.parametrize("cut", [0, 1, 700, 2999, 3000])
def test_snapshot_and_tail_equal_the_whole_log(spark, cut):
    events = log(cut + 1)
    known = set(range(20))
    _, early = replay(events[:cut], known)
    told, whole = replay(events[cut:], known, early)
    snapshot = snapshot_of(spark, early)
    tail = spark.createDataFrame(events[cut:], SCHEMA)
    got = {(r.user_id, r.listing_id): (r.decision, r.decided_at, r.deleted_at) for r in de.fold(snapshot, tail).collect()}
    assert got == whole
    listings = spark.createDataFrame([(i,) for i in known], "listing_id long")
    assert {r.seq: r.outcome for r in de.outcomes(tail, listings, snapshot).collect()} == told
    pages = {(r.user_id, r.listing_id): r.page_id for r in de.fold(snapshot, tail).collect()}
    assert all(pages[k] == (f"page{k[1]}" if k in early else None) for k in whole)


def test_maps_compose(spark):
    """The map of two stretches is what both do, one after the other, for all maps of up to three events."""
    maps = {de._STAY}
    apply = lambda m, s: m >> (3 * s) & 7
    single = [de._packed(m) for m in de.MOVES.values()]
    for _ in range(3):
        maps |= {de._packed([apply(g, apply(f, s)) for s in range(5)]) for f in maps for g in single}
    pairs = [(f, g) for f in maps for g in maps]
    rows = spark.createDataFrame(pairs, "f int, g int").select("f", "g", de._then(F.col("f"), F.col("g")).alias("h")).collect()
    assert all(apply(r.h, s) == apply(r.g, apply(r.f, s)) for r in rows for s in range(5))
