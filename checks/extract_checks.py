"""Mark-up written from the tables, read back by the extraction job."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import scratch
from checks.state_checks import text_ts
from checks.views import Views, now, sql
from kvartal.functions import html as h
from kvartal.functions import listing_text as lt
from kvartal.functions import text as tx
from kvartal.operators import extract as ex
from kvartal.sources import pages as pg
from kvartal.streaming import details as sd

BASE = "https://example.test"
NBSP = " "


def _s(c):
    return c.cast("string") if not isinstance(c, str) else F.lit(c)


def _join(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(v: Views):
    line = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice",
        "l_linestatus", "l_returnflag",
    )
    return line.select(
        "*",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.floor("l_extendedprice").cast("bigint") * 1000).alias("price"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("at"),
    )


def _card_html(line):
    """Card of a line (a struct): image anchor first, some fields missing, noise numbers."""
    title = F.when(
        line["l_linenumber"] != 7,
        _join(line["l_linenumber"], "-комнатная квартира", F.when(line["l_quantity"] != 50, _join(" · ", line["l_quantity"], " м²")).otherwise(F.lit(""))),
    ).otherwise(F.lit("Студия"))
    spaced = F.replace(F.call_function("format_number", line["price"], F.lit(0)), F.lit(","), F.lit(NBSP))
    price = F.when(line["l_partkey"] % 8 != 0, _join('<div class="a-card__price"> ', spaced, " ₸</div>")).otherwise(F.lit(""))
    floor = F.when(line["l_partkey"] % 11 != 0, _join(", потолки 3.1м, дом 88/4, этаж ", line["l_partkey"] % 9 + 1, "/9")).otherwise(F.lit(""))
    name = F.when(line["l_partkey"] % 6 != 0, _join('<a class="a-card__title" href="/a/show/', line["id"], '">', title, "</a>")).otherwise(
        _join("<h3>", title, "</h3>")
    )
    return _join(
        '<article class="a-card"><div class="a-card__inc"><a href="/a/show/', line["id"], "?srchid=1&pos=2#x\"><img src='p.jpg'></a></div>",
        name, price, '<div class="a-card__subtitle">Город, ', line["l_returnflag"], " р-н| ул. ", line["l_partkey"], "</div>",
        '<div class="a-card__text-preview">описание<br>&nbsp;x', floor, "</div></article>",
    )


def listing_pages(v):
    """One crawled page per order; every card of the order is on it."""
    # the lines travel, not their mark-up
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "price", "l_returnflag", "id")
    grouped = _lines(v).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("cs"))
    html = F.concat(
        F.lit("<html><body><!-- <a href='/a/show/1'>no</a> --><section class='a-list'>"),
        F.array_join(F.transform("cs", _card_html), "\n"),
        F.lit("<a href='/help'>help</a></section><footer>reCAPTCHA</footer></body></html>"),
    )
    return _spread(v, grouped).select(
        F.concat(F.lit(BASE + "/list?page="), F.col("l_orderkey").cast("string")).alias("url"),
        F.col("l_orderkey").alias("page_no"), html.alias("html"), F.lit(200).alias("status"),
    )


V_CARDS = """
, lines AS (SELECT *, l_orderkey * 10 + l_linenumber AS id, CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS no FROM lineitem),
cards AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_linenumber || '-комнатная квартира'
      || CASE WHEN l_quantity <> 50 THEN ' · ' || l_quantity || ' м²' ELSE '' END ELSE 'Студия' END AS title,
    CASE WHEN l_partkey % 8 <> 0 THEN price END AS price_kzt, CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS rooms,
    CASE WHEN l_quantity <> 50 AND l_linenumber <> 7 THEN l_quantity END AS area_m2,
    CASE WHEN l_partkey % 11 <> 0 THEN (l_partkey % 9 + 1) || '/9' END AS floor, l_returnflag || ' р-н' AS district,
    'Город, ' || l_returnflag || ' р-н| ул. ' || l_partkey AS address
  FROM lines QUALIFY row_number() OVER (PARTITION BY id ORDER BY no) = 1)
"""


def _details_html():
    k, size = F.col("l_partkey"), F.col("l_suppkey")

    def opt(cond, *parts):
        return F.when(cond, _join(*parts)).otherwise(F.lit(""))

    owner = (
        F.when(k % 4 == 1, F.lit('"owner" : {"label":{"t":"x"},"isOwner":true}'))
        .when(k % 4 == 2, F.lit('"owner":{"isOwner":false,"isBuilder":true}'))
        .when(k % 4 == 3, _join('"owner":{"id":1},"owner":{"isOwner":false,"a":{"b":{}}},"agency":{"logo":1},"agency":{"name":" Top ', k, ' "}'))
        .otherwise(F.lit('"owner":{"isOwner":'))
    )
    dates = (
        F.when(k % 5 == 0, F.lit('"addedAt":"2001-03-04T10:00:00","createdAt": "2001-02-30"'))
        .when(k % 5 == 1, F.lit('"addedAt":"2001-03-04","createdAt":"2000-01-02"'))
        .otherwise(F.lit('"x":1'))
    )
    photo = "https://krd.kcdn.online/webp/8d/"
    return _join(
        "<html><head><title>Продажа №", F.col("id"), ": Адрес ", k, opt(k % 5 == 3, " — за 10 ₸"), " — Сайт</title></head><body>",
        opt(k % 4 != 0, '<h1 class="offer__title">Квартира №', F.col("id"), "</h1>"),
        opt(k % 3 == 0, '<div class="offer__price">от ', F.col("price") + 1000000, " ₸</div>"),
        opt(k % 5 < 3, '<div class="offer__address">Город, Речной район, дом ', size, "</div>"),
        '<ul class="offer__info"><li>Комнат: ', size % 5 + 1, "</li><li>Площадь: ", size + 30, ",5 кв. м</li><li>Этаж: ", size % 9 + 1, " / 12</li></ul>",
        "<dl><dt>Год постройки</dt><dd>сдан в ", size % 100 + 1950, "</dd><dt>Высота потолков</dt><dd>", size % 3 + 2, ",7 м</dd><dt></dt><dd>z</dd></dl>",
        "<dl><dt>год постройки (2)</dt><dd>1900</dd></dl>",
        '<div class="row"><div class="offer__info-title">Тип дома</div><div class="offer__advert-short-info">панель ', size % 4, "</div></div>",
        opt(k % 2 == 0, '<div class="row"><div class="offer__info-title">Состояние квартиры</div><b class="offer__advert-short-info">свежий <i>ремонт</i></b></div>'),
        '<div class="js-description"> Первая <p>строка ', k, "</p>\n\n\n\n вторая </div>",
        opt(k % 7 == 0, "<p>На ", size % 20, ",5 % дешевле</p>"), opt(k % 7 == 1, "<p>на ", size % 20, "% ДОРОЖЕ</p>"),
        opt(k % 5 == 2, '<time datetime="2000-05-06T07:00:00+05:00">x</time>'), opt(k % 5 == 3, "<p>от 07.08.2000 и 01.01.2001</p>"),
        "<img src='https://krd.kcdn.online/content/aa/banner-750x470.jpg'><script>{", owner, "}{", dates, '}</script>',
        '<img src="', photo, F.col("id"), '/1-120x90.jpg"><img src="', photo, F.col("id"), '/1-full.jpg">',
        opt(k % 3 != 1, '<img data-src="', photo, F.col("id"), '/2-400x300.png">'), "</body></html>",
    )


def _spread(v, rows):
    """Made-up pages come from few rows; give every core a share, as files would."""
    return rows.repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")))


def detail_pages(v):
    first = _lines(v).groupBy("id").agg(
        F.min_by(F.struct("l_orderkey", "l_partkey", "l_suppkey", "price"), F.col("at")).alias("r")
    ).select("id", "r.*")
    return _spread(v, first).select(
        F.col("id").cast("string").alias("external_id"), _details_html().alias("html")
    )


def _previews(v):
    return ex.previews(ex.open_pages(listing_pages(v)), BASE)


def _listings(v):
    rows = _previews(v).withColumn("city", F.lit(" Город "))
    return ex.merge_detail(rows, ex.detail_fields(detail_pages(v)), "site", now())


def _of_previews(*names):
    return lambda v: _previews(v).select("external_id", *names)


def _of_listings(*names):
    return lambda v: _listings(v).select("external_id", *names)


def p1(v):
    k = F.col("o_orderkey")
    html = (
        F.when(k % 4 == 0, F.lit("<p>Please Verify you are HUMAN</p>"))
        .when(k % 4 == 1, F.lit("<p>captcha</p><div class='A-Card'>"))
        .when(k % 4 == 2, F.lit("<p>plain</p>"))
        .otherwise(F.lit("Access Denied <h1 class=offer__title>"))
    )
    status = F.when(k % 10 == 0, 429).when(k % 10 < 8, 200)
    rows = v.table("orders").select(k.alias("page_id"), lt.is_blocked(html, status).alias("blocked"))
    own = v.table("pages").select((-F.col("page_id") - 1).alias("page_id"), lt.is_blocked("html").alias("blocked"))
    return rows.unionByName(own)


def p4(v):
    return v.table("pages").select(
        "page_id", lt.absolute_url("url", BASE).alias("url"), lt.display_url("url").alias("shown"),
        lt.absolute_url(F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit("?a=1#b")), BASE + "/").alias("joined"),
    )


def p11(v):
    p = v.table("part")
    return p.select(
        "p_partkey",
        tx.first_non_empty(
            F.when(F.col("p_partkey") % 2 == 0, F.lit("")).when(F.col("p_partkey") % 3 == 0, F.col("p_brand")),
            F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")), F.col("p_name"),
        ).alias("value"),
    )


def p12(v):
    return _listings(v).select("external_id", F.array_join("photos", " ").alias("photos"))


def p13(v):
    return _listings(v).select("external_id", text_ts("published_at"))


def p15(v):
    pages = detail_pages(v)
    pages = pages.select("external_id", h.detail_texts("html").alias("d"))
    params = tx.first_by(F.col("d.params"), "label")
    shown = F.array_join(F.transform(params, lambda e: F.concat(e["label"], F.lit("="), e["value"])), "; ")
    return pages.select("external_id", shown.alias("params"))


def p20(v):
    """Listings with every eleventh attribute spoilt."""
    rows = _listings(v)
    key = F.col("external_id").cast("bigint")
    rows = rows.withColumns(
        {
            "price_kzt": F.when(key % 11 == 0, F.lit(0).cast("bigint")).otherwise(F.coalesce("price_kzt", F.lit(1).cast("bigint"))),
            "url": F.when(key % 11 == 1, F.lit("/a/show/1")).otherwise(F.col("url")),
            "build_year": F.when(key % 11 == 2, F.lit(1800)).otherwise(F.col("build_year")),
            "posted_by": F.when(key % 11 == 3, F.lit("robot")).otherwise(F.col("posted_by")),
            "photos": F.when(key % 11 == 4, F.array(F.lit("x.jpg"))).otherwise(F.col("photos")),
        }
    )
    good, bad = ex.split_valid(rows, ex.listing_problems())
    return bad.select("external_id", F.array_join("problems", ",").alias("problems")).unionByName(
        good.select("external_id", F.lit("").alias("problems"))
    )


def p20b(v):
    c = v.criteria.withColumns(
        {
            "max_price_kzt": F.when(F.col("user_id") % 7 == 0, F.col("min_price_kzt") - 1).otherwise(F.col("max_price_kzt")),
            "rooms": F.when(F.col("user_id") % 7 == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.col("rooms")),
            "districts": F.when(F.col("user_id") % 7 == 2, F.array(F.lit(" "))).otherwise(F.col("districts")),
            "page_limit": F.when(F.col("user_id") % 7 == 3, 21).otherwise(F.col("page_limit")),
        }
    )
    return c.select("user_id", F.array_join(ex.criteria_problems(), ",").alias("problems"))


def s1(v):
    """Readable crawled pages per kind: the listing pages written out as a table."""
    pages = pg.conform(listing_pages(v).withColumn("kind", F.lit("listing")))
    return ex.open_pages(pages).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls")
    )


def s2(v):
    urls = pg.crawl_plan(v.criteria, v.catalog, BASE)
    return urls.select("user_id", "page", "url", "error")


def p19_stream(v):
    """Both kinds of pages as streams: of seven details one never comes and one comes too late.

    One empty card and page later than all others carry the watermarks past them.
    """
    start, beat = now(), now() + F.expr("INTERVAL 30 DAYS")
    minutes = F.make_dt_interval(mins=(F.col("page_no") % 600).cast("int"))
    pages = listing_pages(v).select("*", F.lit(" Город ").alias("city"), (start + minutes).alias("fetched_at"))
    last = v.spark.range(1).select(
        F.lit("u").alias("url"), F.lit(0).cast("long").alias("page_no"),
        F.lit('<article class="a-card"><a href="/a/show/0">x</a></article>').alias("html"),
        F.lit(200).alias("status"), F.lit("x").alias("city"), beat.alias("fetched_at"),
    )
    key = F.col("external_id").cast("bigint")
    after = F.when(key % 7 == 1, 61).otherwise(key % 61)
    shown = F.make_dt_interval(mins=(F.floor(key / 10) % 600).cast("int"))
    details = detail_pages(v).where(key % 7 != 0).select(
        "external_id", "html", F.lit(200).alias("status"), (start + shown + F.make_dt_interval(mins=after.cast("int"))).alias("fetched_at")
    )
    end = v.spark.range(1).select(
        F.lit("-1").alias("external_id"), F.lit('<h1 class="offer__title">x</h1>').alias("html"), F.lit(200).alias("status"),
        beat.alias("fetched_at"),
    )
    root = scratch.folder(v.spark, "details")
    streams = []
    for name, rows in (("pages", pages.unionByName(last)), ("details", details.unionByName(end))):
        rows.write.parquet(f"{root}/{name}")
        streams.append(v.spark.readStream.schema(rows.schema).parquet(f"{root}/{name}"))
    out = sd.listings(*streams, BASE, "site")
    query = (
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return v.spark.read.schema(out.schema).parquet(f"{root}/out").select(
        "external_id", "detailed", "title", "price_kzt", "city", "district", "rooms", "area_m2", "floor"
    )


def u4(v):
    rows = _previews(v).select("page_no", "card_pos", "external_id")
    placed = pg.in_page_order(rows, ["page_no"])
    return placed.select("external_id", F.col("place.page_no").alias("page_no"), F.col("place.card_pos").alias("card_pos"))


def _with(body: str, extra: str = "") -> str:
    base = sql("SELECT 1", "v_cities")
    return base[: base.rindex("SELECT 1")] + V_CARDS.strip() + extra + body


V_DETAILS = """
, det AS (SELECT *, CAST(id AS VARCHAR) AS external_id, l_partkey AS k, l_suppkey AS s,
  CASE l_partkey % 5 WHEN 3 THEN 'Адрес ' || l_partkey WHEN 4 THEN address ELSE 'Город, Речной район, дом ' || l_suppkey END AS full_address FROM cards)
"""


def _det(body: str) -> str:
    return _with(body, V_DETAILS)


_ID = "CAST(id AS VARCHAR) AS external_id"
CHECKS = {
    "P1_blocked_page": (
        p1,
        """SELECT o_orderkey AS page_id, o_orderkey % 4 = 0 OR o_orderkey % 10 = 0 AS blocked FROM orders
UNION ALL SELECT -page_id - 1, regexp_matches(lower(html), 'captcha|verify you are human|too many requests|access denied')
  AND NOT regexp_matches(lower(html), '/a/show/|a-card|offer__price|offer__title') FROM pages""",
    ),
    "P2_cards": (
        lambda v: _previews(v).select("page_no", "card_pos", "external_id", "title"),
        _with(f"""SELECT l_orderkey AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY no) - 1 AS card_pos, {_ID}, title FROM cards"""),
    ),
    "P3_external_id": (_of_previews("url"), _with(f"SELECT {_ID}, '{BASE}/a/show/' || id AS url FROM cards")),
    "P4_clean_url": (
        p4,
        f"""SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, replace(regexp_replace(url, '[?#].*$', ''), '//m.', '//') AS shown,
  '{BASE}/p/' || page_id AS joined FROM pages""",
    ),
    "P5_price": (_of_previews("price_kzt"), _with(f"SELECT {_ID}, price_kzt FROM cards")),
    "P6_rooms": (_of_previews("rooms"), _with(f"SELECT {_ID}, rooms FROM cards")),
    "P7_area": (_of_previews("area_m2"), _with(f"SELECT {_ID}, area_m2 FROM cards")),
    "P8_floor": (_of_previews("floor"), _with(f"SELECT {_ID}, floor FROM cards")),
    "P9_district_label": (_of_previews("district"), _with(f"SELECT {_ID}, district FROM cards")),
    "P10_address": (_of_listings("address"), _det("SELECT external_id, full_address AS address FROM det")),
    "P11_first_non_empty": (
        p11,
        """SELECT p_partkey, CASE WHEN p_partkey % 2 <> 0 AND p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 5 = 0 THEN p_type
  ELSE p_name END AS value FROM part""",
    ),
    "P12_photos": (
        p12,
        _det(
            """SELECT external_id, 'https://krd.kcdn.online/webp/8d/' || id || '/1-750x470.jpg'
  || CASE WHEN k % 3 <> 1 THEN ' https://krd.kcdn.online/webp/8d/' || id || '/2-750x470.jpg' ELSE '' END AS photos FROM det"""
        ),
    ),
    "P13_published_at": (
        p13,
        _det(
            """SELECT external_id, CASE k % 5 WHEN 0 THEN '2001-03-04 00' WHEN 1 THEN '2000-01-02 00' WHEN 2 THEN '2000-05-06 02'
  WHEN 3 THEN '2000-08-07 00' END || ':00:00.000000' AS published_at FROM det"""
        ),
    ),
    "P14_posted_by": (
        _of_listings("posted_by", "agency_name"),
        _det(
            """SELECT external_id, CASE k % 4 WHEN 1 THEN 'owner' WHEN 2 THEN 'developer' WHEN 3 THEN 'agent' END AS posted_by,
  CASE WHEN k % 4 = 3 THEN 'Top ' || k END AS agency_name FROM det"""
        ),
    ),
    "P15_params_first_wins": (
        p15,
        _det(
            """SELECT external_id, 'год постройки=сдан в ' || (s % 100 + 1950) || '; высота потолков=' || (s % 3 + 2) || ',7 м; год постройки (2)=1900; тип дома=панель '
  || (s % 4) || CASE WHEN k % 2 = 0 THEN '; состояние квартиры=свежий ремонт' ELSE '' END AS params FROM det"""
        ),
    ),
    "P16_param_lookup": (
        _of_listings("build_year", "building_type", "ceiling_height_m", "furnished", "condition"),
        _det(
            """SELECT external_id, s % 100 + 1950 AS build_year, 'панель ' || (s % 4) AS building_type,
  CAST((s % 3 + 2) || '.7' AS DOUBLE) AS ceiling_height_m, CAST(NULL AS VARCHAR) AS furnished,
  CASE WHEN k % 2 = 0 THEN 'свежий ремонт' END AS condition FROM det"""
        ),
    ),
    "P17_description": (
        _of_listings("description"),
        _det("SELECT external_id, 'Первая' || chr(10) || 'строка ' || k || chr(10) || 'вторая' AS description FROM det"),
    ),
    "P18_market_diff": (
        _of_listings("market_diff_percent"),
        _det(
            """SELECT external_id, CASE k % 7 WHEN 0 THEN -CAST((s % 20) || '.5' AS DOUBLE) WHEN 1 THEN CAST(s % 20 AS DOUBLE) END AS market_diff_percent FROM det"""
        ),
    ),
    "P19_detail_merge": (
        _of_listings("title", "price_kzt", "city", "district", "rooms", "area_m2", "floor"),
        _det(
            """SELECT external_id, CASE WHEN k % 4 <> 0 THEN 'Квартира №' || id ELSE title END AS title,
  CASE WHEN k % 3 = 0 THEN price + 1000000 ELSE price_kzt END AS price_kzt, 'Город' AS city,
  CASE WHEN k % 5 IN (0, 1, 2) THEN 'Речной район' ELSE district END AS district, coalesce(rooms, s % 5 + 1) AS rooms,
  coalesce(area_m2, CAST((s + 30) || '.5' AS DOUBLE)) AS area_m2, coalesce(floor, (s % 9 + 1) || '/12') AS floor FROM det"""
        ),
    ),
    "P19_detail_stream": (
        p19_stream,
        _det(
            """SELECT external_id, on_time AS detailed, CASE WHEN on_time AND k % 4 <> 0 THEN 'Квартира №' || id ELSE title END AS title,
  CASE WHEN on_time AND k % 3 = 0 THEN price + 1000000 ELSE price_kzt END AS price_kzt, 'Город' AS city,
  CASE WHEN on_time AND k % 5 IN (0, 1, 2) THEN 'Речной район' ELSE district END AS district,
  CASE WHEN on_time THEN coalesce(rooms, s % 5 + 1) ELSE rooms END AS rooms,
  CASE WHEN on_time THEN coalesce(area_m2, CAST((s + 30) || '.5' AS DOUBLE)) ELSE area_m2 END AS area_m2,
  CASE WHEN on_time THEN coalesce(floor, (s % 9 + 1) || '/12') ELSE floor END AS floor FROM (SELECT *, id % 7 > 1 AS on_time FROM det)"""
        ),
    ),
    "P20_listing_quarantine": (
        p20,
        _det(
            """SELECT external_id, CASE id % 11 WHEN 0 THEN 'price_kzt' WHEN 1 THEN 'url' WHEN 2 THEN 'build_year' WHEN 3 THEN 'posted_by'
  WHEN 4 THEN 'photos' ELSE '' END AS problems FROM det"""
        ),
    ),
    "P20_criteria_quarantine": (
        p20b,
        """SELECT c_custkey AS user_id, concat_ws(',', CASE WHEN c_custkey = 0 THEN 'user_id' END,
  CASE WHEN c_custkey % 7 = 0 AND floor(greatest(c_acctbal, 0)) = 0 THEN 'max_price_kzt' END,
  CASE c_custkey % 7 WHEN 0 THEN 'price_range' WHEN 1 THEN 'rooms' WHEN 2 THEN 'districts' WHEN 3 THEN 'page_limit' END) AS problems FROM customer""",
    ),
    "S1_crawled_pages": (
        s1,
        "SELECT 'listing' AS kind, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey) AS urls FROM lineitem",
    ),
    "S2_crawl_plan": (
        s2,
        sql(
            f"""SELECT user_id, CASE WHEN slug IS NOT NULL THEN page END AS page, CASE WHEN slug IS NOT NULL THEN
  '{BASE}/prodazha/kvartiry/' || slug || '/?page=' || page || '&das%5Bprice%5D%5Bfrom%5D=' || min_price_kzt
  || '&das%5Bprice%5D%5Bto%5D=' || max_price_kzt
  || coalesce(array_to_string(list_transform(rooms, lambda r: '&das%5Blive.rooms%5D%5B%5D=' || r), ''), '')
  || '&das%5Blive.square%5D%5Bfrom%5D=30&das%5Blive.square%5D%5Bto%5D=60' || CASE WHEN owner_only THEN '&das%5Bwho%5D=1' ELSE '' END END AS url,
  CASE WHEN slug IS NULL THEN 'city has no slug' END AS error
FROM (SELECT c.*, y.slug, unnest(CASE WHEN y.slug IS NULL THEN [1] ELSE generate_series(1, page_limit) END) AS page
  FROM v_criteria c JOIN v_cities y USING (city))""",
            "v_criteria", "v_cities",
        ),
    ),
    "U4_page_order": (
        u4,
        _with(
            """SELECT page_no, card_pos, external_id FROM (
  SELECT l_orderkey AS page_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY no) - 1 AS card_pos, CAST(id AS VARCHAR) AS external_id FROM cards)"""
        ),
    ),
}
