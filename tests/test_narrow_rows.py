"""Rows that travel hold nothing twice, and no mark-up that can be written after the shuffle."""

from checks import extract_checks as ec
from checks.views import Views
from kvartal.operators import match as m
from kvartal.operators import state as st


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_last_row_carries_its_order_once(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w")], "k string, at int, v string")
    last = st.last_per_key(rows, ["k"], ["at"])
    assert "max_by" not in _plan(last)
    assert sorted(tuple(r) for r in last.collect()) == [("a", 2, "z"), ("b", None, "w")]
    maps = spark.createDataFrame([("a", 1, {"x": 1}), ("a", 2, {"y": 2})], "k string, at int, v map<string,int>")
    assert st.last_per_key(maps, ["k"], ["at"]).first().v == {"y": 2}


def test_upsert_looks_for_the_last_row_once(spark):
    cols = "source string, external_id string, url string, price long, created_at int"
    old = spark.createDataFrame([("s", "1", "u1", 1, 0)], cols)
    new = spark.createDataFrame([("s", "1", "u1", 5, 1), ("s", "1", "u1", 6, 2), ("s", "2", "u2", None, 1)], cols)
    snapshot, _ = st.upsert_listings(old, new, ["created_at"])
    assert "max_by" not in _plan(snapshot)
    assert sorted((r.external_id, r.price, r.created_at) for r in snapshot.collect()) == [("1", 6, 0), ("2", None, 1)]


def test_clone_carries_what_decides_once(spark):
    cols = "external_id string, city string, price_kzt long, rooms int, area_m2 double, floor string, address string, at int"
    flat = (2, 40.0, "1/9", "A 1")
    rows = [("a", "C", None, *flat, 1), ("b", "C", 7, *flat, 4), ("c", "C", 7, *flat, 3), ("d", "C", 9, *flat, 2), ("e", "C", 1, None, 40.0, "1/9", "A 1", 5)]
    out = m.collapse_clones(spark.createDataFrame(rows, cols), ["city"], ["at"])
    assert "min_by" not in _plan(out)
    assert sorted((r.external_id, r.place.at) for r in out.collect()) == [("c", 1), ("e", 5)]


def test_pages_are_written_after_the_shuffle(spark):
    plan = _plan(ec.listing_pages(Views(spark, "/root/testdata/sf0.001")))
    below = plan[plan.index("Aggregate ["):]
    assert "a-card" in plan and "a-card" not in below
