"""Ordered rules against a plain replay of random logs."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from kvartal.operators import claims as cl
from kvartal.operators import state as st
from kvartal.operators.skew import carry_last, salted_join
from kvartal.plans import requests as rq

START = dt.datetime(2026, 1, 1)


def replay(ops):
    state, decided, deleted = None, None, None
    for ts, op in ops:
        if op in ("save", "reject"):
            state, decided, deleted = ("saved" if op == "save" else "rejected"), ts, None
        elif op == "delete_saved" and state == "saved" and deleted is None:
            deleted = ts
        elif op == "restore" and state == "saved" and deleted is not None:
            deleted = None
        elif op == "restore" and state == "rejected" and deleted is None:
            state = None
        elif op == "purge" and state is not None and (deleted is not None or state == "rejected"):
            state, deleted = "rejected", ts
    return None if state is None else (state, decided, deleted)


@pytest.mark.parametrize("seed", [1, 2])
def test_feedback_state_equals_replay(spark, seed):
    rnd = random.Random(seed)
    rows, logs = [], {}
    for seq in range(3000):
        key = (1, 1) if rnd.random() < 0.3 else (rnd.randrange(20), rnd.randrange(20))
        ts = START + dt.timedelta(hours=seq // 2)
        op = rnd.choice(["save", "reject", "delete_saved", "restore", "purge", "purge", "delete_saved"])
        rows.append((*key, ts, seq, op))
        logs.setdefault(key, []).append((ts, op))
    df = spark.createDataFrame(rows, "user_id long, listing_id long, ts timestamp, seq long, op string")
    got = {(r.user_id, r.listing_id): (r.decision, r.decided_at, r.deleted_at) for r in st.feedback_state(df).collect()}
    want = {k: replay(v) for k, v in logs.items()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_limiter_truth_table(spark):
    rows = [(1, START + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 4, 60, 61, 200])]
    out = cl.limiter(spark.createDataFrame(rows, "user_id long, ts timestamp, seq long"), 3, 60).orderBy("seq").collect()
    assert [r.verdict for r in out] == ["accepted"] * 3 + ["warned", "silent", "silent", "accepted", "accepted"]


def test_limiter_and_claims_equal_replay(spark, tmp_path):
    rnd = random.Random(5)
    at = START
    rows = []
    for seq in range(2000):
        at += dt.timedelta(seconds=rnd.choice([1, 3, 10, 90]))
        rows.append((7 if rnd.random() < 0.4 else rnd.randrange(5), at, seq))
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, seq long")
    got = {r.seq: r.verdict for r in cl.limiter(df, 4, 60).collect()}
    state, want = {}, {}
    for user, ts, seq in rows:
        micros = int((ts - START).total_seconds() * 1e6) + 10**12
        state[user], out = cl.limit_step(state.get(user), {"micros": micros, "seq": seq}, 4, 60_000_000)
        want[seq] = out["verdict"]
    assert got == want
    req = df.select(
        F.lit("search").alias("namespace"), "user_id", (F.col("seq") % 2).cast("string").alias("external_id"), "ts", "seq",
        (F.col("seq") % 3 != 0).alias("fits"),
    )
    got = {r.seq: r.verdict for r in cl.claims(req, str(tmp_path), 120).collect()}
    state, want = {}, {}
    for user, ts, seq in rows:
        key = (user, seq % 2)
        micros = int((ts - START).total_seconds() * 1e6) + 10**12
        state[key], out = cl.claim_step(state.get(key), {"micros": micros, "seq": seq, "fits": seq % 3 != 0}, 120_000_000)
        want[seq] = out["verdict"]
    assert got == want


def test_claims_of_a_key_that_never_pauses(spark, tmp_path):
    """A third of all requests on one key without a pause, with ties, repeats, nulls and an empty log."""
    rnd = random.Random(8)
    rows = []
    for seq in range(3000):
        hot = rnd.random() < 0.35
        at = START + dt.timedelta(seconds=rnd.randrange(0, 4 * 86_400, 60))
        rows.append(("search", 1 if hot else 2 + rnd.randrange(40), "a", at, seq, rnd.choice([True, False, None])))
    rows += rows[:50] + [("search", 1, "a", None, -1, True), ("search", None, "a", START, -2, True)]
    schema = "namespace string, user_id long, external_id string, ts timestamp, seq long, fits boolean"
    log = spark.createDataFrame(rows, schema)
    out = cl.claims(log, f"{tmp_path}/a", 3600)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.user_id, r.seq, r.verdict) for r in out.collect())
    state, want = {}, []
    known = [(u, t, s, bool(f)) for _, u, _, t, s, f in rows if u is not None and t is not None]
    for user, ts, seq, fits in sorted(known, key=lambda r: (r[1], r[2], not r[3])):
        micros = int((ts - START).total_seconds() * 1e6) + 10**12
        state[user], step = cl.claim_step(state.get(user), {"micros": micros, "seq": seq, "fits": fits}, 3_600_000_000)
        want.append((user, seq, step["verdict"]))
    assert got == sorted(want)
    assert sum(v == "delivered" for u, _, v in got if u == 1) > 60
    # more rounds than a handful would mean one round a delivery
    assert len([n for n in os.listdir(f"{tmp_path}/a") if n.startswith("won-")]) <= 8
    assert cl.claims(log.limit(0), f"{tmp_path}/b", 3600).count() == 0


def test_carry_last_equals_one_window(spark):
    df = spark.range(2000).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("o"), F.when(F.hash("id") % 5 == 0, F.col("id")).alias("v")
    )
    for inclusive in (True, False):
        got = carry_last(df, ["k"], ["o"], {"c": F.col("v")}, F.floor(F.col("o") / 50), inclusive)
        frame = "current row" if inclusive else "1 preceding"
        df.createOrReplaceTempView("t")
        want = spark.sql(
            f"select *, last(v, true) over (partition by k order by o rows between unbounded preceding and {frame}) c from t"
        )
        assert sorted(map(tuple, got.select("k", "o", "c").collect()), key=str) == sorted(
            map(tuple, want.select("k", "o", "c").collect()), key=str
        )


def test_salted_join_equals_plain_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("a"))
    probe = spark.range(60).select((F.col("id") % 45).alias("k"), F.col("id").alias("b"))
    got = salted_join(big, probe, ["k"], ["a"], None, rows_per_split=100)
    assert sorted(map(tuple, got.select("k", "a", "b").collect())) == sorted(
        map(tuple, big.join(probe, "k").select("k", "a", "b").collect())
    )


def test_criteria_history(spark, catalog, tmp_path):
    steps = [
        ("refine", "до 40 млн"),
        ("search", "двушка в Астане, Есильский район до 30 млн"),
        ("refine", "от 50 млн"),
        ("refine", "от 10 млн"),
        ("refine", "привет"),
        ("refine", "посуточно"),
        ("refine", "до 20 тыс, от хозяина"),
        ("refine", "в Алматы"),
        ("search", "в Шу"),
        ("set_district", None),
        ("set_deal", None),
        ("toggle_owner", None),
        ("set_city", "Астане"),
        ("set_city", "Париж"),
    ]
    rows = [
        (i, 1, START + dt.timedelta(hours=30 * i), i, kind, text, None, "sale", None, "Медеуский" if kind == "set_district" else None)
        for i, (kind, text) in enumerate(steps)
    ]
    schema = "msg_id long, user_id long, ts timestamp, seq long, kind string, message string, patch string, edit_deal string, edit_period string, edit_district string"
    out = rq.criteria_history(spark.createDataFrame(rows, schema), catalog, "Almaty", str(tmp_path)).orderBy("seq").collect()
    assert [r.status for r in out[:8]] == ["no active criteria", "ok", "invalid range", "ok", "unchanged", "ok", "ok", "ok"]
    assert (out[2].min_price_kzt, out[2].max_price_kzt) == (None, 30_000_000)
    assert (out[3].min_price_kzt, out[3].max_price_kzt, out[3].city, out[3].districts) == (10_000_000, 30_000_000, "Astana", ["Есильский"])
    assert (out[5].deal_type, out[5].rent_period, out[5].min_price_kzt, out[5].max_price_kzt) == ("rent", "daily", None, None)
    assert (out[6].max_price_kzt, out[6].owner_only, out[6].rooms) == (20_000, True, [2])
    assert (out[7].city, out[7].districts) == ("Almaty", None)
    assert "распознан" in out[8].status and out[8].city == "Almaty"
    assert out[9].districts == ["Медеуский"]
    assert (out[10].status, out[10].deal_type, out[10].rent_period, out[10].max_price_kzt) == ("budget_reset", "sale", None, None)
    assert out[11].owner_only is False
    assert (out[12].status, out[12].city, out[12].districts) == ("ok", "Astana", None)
    assert (out[13].status, out[13].city) == ("unknown_city", "Astana")
