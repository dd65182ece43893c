"""Page texts are worked out once, and only what is asked for."""

from pyspark.sql import functions as F

from kvartal.functions import html as h
from kvartal.functions import listing_text as lt
from kvartal.operators import extract as ex


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_posters_alone_read_no_mark_up(spark):
    page = '<h1 class="offer__title">T</h1><script>{"owner":{"isOwner":false},"agency":{"name":" Top "}}</script>'
    pages = spark.createDataFrame([("1", page), ("2", "<p>x</p>"), ("3", None)], "external_id string, html string")
    rows = ex.detail_fields(pages).select("external_id", "posted_by", "agency_name")
    assert "detail_texts" not in plan(rows)
    assert {tuple(r) for r in rows.collect()} == {("1", "agent", "Top"), ("2", None, None), ("3", None, None)}


def test_blocked_pages_are_looked_at_once(spark):
    made = spark.range(3).select("id", F.concat(F.lit("<p>Captcha</p> "), F.col("id").cast("string"), F.lit(" A-CARD")).alias("html"))
    kept = made.where(~lt.is_blocked("html"))
    filters = [line for line in plan(kept).splitlines() if "Filter" in line]
    assert sum(line.count("lower(") for line in filters) == 1
    assert kept.count() == 3


def test_tags_with_addresses_of_their_own_are_not_remembered():
    before = h._head.cache_info().misses
    for i in range(500):
        assert h.scan(f'<img src="https://example.test/photos/of/listings/{i}.jpg"><a class="c" href="/a/show/{i}?a=1&b=2#x">t</a>') is not None
    assert h._head.cache_info().misses - before < 5
    assert len(h._HEADS) <= h.KEPT_HEADS


def test_texts_are_decoded_when_asked_for(monkeypatch):
    decoded = []
    monkeypatch.setattr(h, "unescape", lambda text: decoded.append(text) or text)
    page = h.scan("<p>a &lt; b</p><h1>c &lt; d</h1>")
    assert not decoded
    assert page.first_text("h1") == "c &lt; d" and decoded == ["c &lt; d"]
