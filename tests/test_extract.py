from pyspark.sql import functions as F

from kvartal.functions import html as h
from kvartal.operators import extract as ex

LISTING = """<html><body><section class="results">
<article class="a-card"><div><a href="/a/show/11?srchid=5"><img></a></div>
 <a class="a-card__title" href="/a/show/11">3-комнатная · 74.2 м² · 4/12 этаж</a>
 <div class="a-card__price">48&nbsp;250 000 ₸</div><div class="a-card__subtitle">Шымкент, Каратауский р-н</div>
 <div class="a-card__text-preview">потолки 3.1м, дом 88/4</div></article>
<article class="a-card"><a class="a-card__title" href="/a/show/22">1-комнатная</a>
 <div class="a-card__subtitle">Сарыарка 9</div></article>
</section><footer>reCAPTCHA</footer></body></html>"""
DETAIL = """<html><head><title>Продажа №22: Сарыарка 9 — за 17 млн — сайт</title></head><body>
<h1>Квартира</h1><div class="offer__price">17 300 000 ₸</div>
<div class="offer__info">Площадь: 36 м² Этаж: 2/4</div>
<dl><dt>Год постройки</dt><dd>1988</dd><dt>Высота потолков</dt><dd>2,5 м</dd></dl>
<div><span class="offer__info-title">Состояние</span><b class="offer__advert-short-info">евроремонт</b></div>
<div class="js-description">Светлая<script>x()</script><p>квартира</p></div>
<script>{"owner":{"label":{"a":1}},"owner":{"isOwner":false,"label":{"a":{}}},"agency":{"name":" North Homes "},"createdAt":"2024-07-11","addedAt":"2024-09-02"}</script>
<p>unclosed</body></html>"""


def test_listing_and_detail_page(spark):
    pages = spark.createDataFrame([("u", 1, LISTING, 200), ("v", 2, "captcha", 200)], "url string, page_no int, html string, status int")
    previews = ex.previews(ex.open_pages(pages), "https://site.test").withColumn("city", F.lit(" Шымкент "))
    one, two = previews.orderBy("card_pos").collect()
    assert (one.external_id, one.url, one.price_kzt, one.rooms, one.area_m2, one.floor, one.district) == (
        "11", "https://site.test/a/show/11", 48_250_000, 3, 74.2, "4/12", "Каратауский р-н",
    )
    assert (two.external_id, two.price_kzt, two.rooms, two.address) == ("22", None, 1, "Сарыарка 9")
    detail_pages = spark.createDataFrame([("22", DETAIL), ("33", "<p>")], "external_id string, html string")
    listing = ex.merge_detail(previews, ex.details_of(previews, detail_pages), "site", F.lit("2026-01-01").cast("timestamp")).collect()
    assert len(listing) == 1
    got = listing[0]
    assert (got.price_kzt, got.title, got.city, got.address, got.rooms, got.area_m2, got.floor) == (
        17_300_000, "Квартира", "Шымкент", "Сарыарка 9", 1, 36.0, "2/4",
    )
    assert (got.posted_by, got.agency_name, got.build_year, got.ceiling_height_m, got.condition) == (
        "agent", "North Homes", 1988, 2.5, "евроремонт",
    )
    assert got.description == "Светлая\nквартира"
    assert str(got.published_at) == "2024-07-11 00:00:00"


def test_card_container_prefers_the_one_subtitle_root():
    page = (
        '<div class="a-card-list"><div class="a-card"><div class="a-card__inc"><a href="/a/show/1">x</a></div>'
        '<p class="a-card__subtitle">S1</p></div><div class="a-card"><a href="/a/show/2">y</a><p class="a-card__subtitle">S2</p></div></div>'
    )
    assert [c["subtitle"] for c in h.cards(page)] == ["S1", "S2"]


def test_invalid_rows_go_to_quarantine(spark):
    cols = "external_id string, url string, title string, price_kzt bigint, city string, area_m2 double, rooms int, posted_by string, build_year int, ceiling_height_m double, photos array<string>"
    rows = [
        ("1", "https://a.b/1", "t", 5, "c", None, None, None, None, None, []),
        ("2", "a.b/1", "t", 0, " ", -1.0, 0, "x", 1800, 0.0, ["p"]),
    ]
    good, bad = ex.split_valid(spark.createDataFrame(rows, cols), ex.listing_problems())
    assert [r.external_id for r in good.collect()] == ["1"]
    assert bad.first().problems == ["url", "price_kzt", "area_m2", "rooms", "posted_by", "build_year", "ceiling_height_m", "photos"]


def test_long_embedded_object_is_read():
    page = '<script>{"owner":{"note":"' + "}x{" * 9000 + '","isOwner":true}}</script>'
    assert '"isOwner": true' in h.detail(page)["owner_json"]
    assert h.detail('<script>{"owner":{"isOwner":</script>')["owner_json"] is None


def test_pages_are_parsed_once_and_pages_without_cards_give_no_row(spark):
    pages = spark.createDataFrame([("u", 1, LISTING, 200), ("v", 2, "<p>x</p>", 200), ("w", 3, None, 200)], "url string, page_no int, html string, status int")
    rows = ex.previews(pages, "https://site.test")
    assert [(r.page_no, r.card_pos, r.external_id) for r in rows.orderBy("card_pos").collect()] == [(1, 0, "11"), (1, 1, "22")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
