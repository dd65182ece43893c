"""Matching, clone collapse, caps and price columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import scratch
from checks.views import NOW, POS, POS_SQL, Views, now, sql
from kvartal.functions import money
from kvartal.operators import match as m
from kvartal.operators import score as s


def _pairs(v: Views, strict: bool = False):
    return m.match(v.criteria, v.listings, strict_district=strict)


def l1(v):
    return _pairs(v).select("user_id", "external_id", "city", "price_kzt")


def f1(v):
    open_criteria = v.criteria.withColumn("districts", F.lit(None).cast("array<string>")).withColumn(
        "district_keys", F.lit(None).cast("array<string>")
    )
    return (
        m.match(open_criteria, v.listings)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("price_kzt").alias("total_price"))
    )


def f2(v):
    found = F.when(F.col("l_partkey") % 5 != 0, F.col("district_key"))
    asked = F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit("A"), F.lit("N")))
    wanted = F.when(
        F.col("l_orderkey") % 4 == 0, F.array(F.lit("A"), F.lit("N"))
    ).when(F.col("l_orderkey") % 2 == 0, F.array().cast("array<string>"))
    return v.listings.select(
        "external_id", m.district_match(found, asked, wanted).alias("verdict")
    )


def f3(v):
    hidden = v.listings.withColumn(
        "district_key", F.when(F.col("l_partkey") % 5 != 0, F.col("district_key"))
    )
    return (
        m.match(v.criteria, hidden, strict_district=True)
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def f4(v):
    return (
        v.listings.where((F.col("deal_type") == "sale") & (F.col("posted_by") == "owner"))
        .groupBy("city")
        .agg(F.count(F.lit(1)).alias("n"), F.min("price_kzt").alias("cheapest"))
    )


def w2(v):
    rows = v.listings.select(
        F.col("l_partkey").cast("string").alias("external_id"), "city", "price_kzt", *POS
    )
    return m.first_per_id(rows, ["city"], POS).select("city", "external_id", "price_kzt", "l_orderkey")


def _collapsed(v):
    keep = v.listings.select(
        "external_id", "city", "deal_type", "price_kzt", "rooms", "area_m2", "floor", "address",
        "district_key", "district", "posted_by", "rent_period", "market_diff_percent", "published_at", *POS,
    )
    return m.collapse_clones(keep, ["city", "deal_type"], POS)


def w3(v):
    return _collapsed(v).select(
        "external_id", "city", "price_kzt",
        F.col("place.l_orderkey").alias("place_order"),
        F.col("place.l_linenumber").alias("place_line"),
    )


W3_BODY = f"""
, ranked AS (
  SELECT *, CASE WHEN rooms IS NOT NULL AND area_m2 IS NOT NULL
      THEN concat_ws('|', rooms, CAST(round_even(area_m2 * 10, 0) AS BIGINT), floor, lower(address))
      ELSE 'own ' || external_id END AS print
  FROM v_listings),
clones AS (
  SELECT *, row_number() OVER (PARTITION BY city, print ORDER BY price_kzt, {POS_SQL}) AS cheap,
    first_value(l_orderkey) OVER (PARTITION BY city, print ORDER BY {POS_SQL}) AS place_order,
    first_value(l_linenumber) OVER (PARTITION BY city, print ORDER BY {POS_SQL}) AS place_line,
    first_value(l_partkey) OVER (PARTITION BY city, print ORDER BY {POS_SQL}) AS place_part,
    first_value(l_suppkey) OVER (PARTITION BY city, print ORDER BY {POS_SQL}) AS place_supp,
    first_value(l_shipdate) OVER (PARTITION BY city, print ORDER BY {POS_SQL}) AS place_date
  FROM ranked),
collapsed AS (SELECT * FROM clones WHERE cheap = 1)
"""


def _with(body: str, *names: str) -> str:
    """SQL whose own CTEs follow the view CTEs (body starts with a comma)."""
    base = sql("SELECT 1", *names)
    return base[: base.rindex("SELECT 1")] + body.strip()


def flagship(v):
    """For every user the first six distinct listings that fit, compared to the batch."""
    out = s.with_batch_comparison(_top(v), ["user_id"])
    return out.select(
        "user_id", "rank", "external_id", "price_kzt",
        F.round("ppm2", 2).alias("ppm2"),
        F.round("batch_avg", 2).alias("batch_avg"),
        "batch_count",
        F.col("verdict.basis").alias("basis"),
        F.col("verdict.word").alias("word"),
        F.col("verdict.percent").alias("percent"),
    )


PRINT = """CASE WHEN l.rooms IS NOT NULL AND l.area_m2 IS NOT NULL
      THEN concat_ws('|', l.rooms, CAST(round_even(l.area_m2 * 10, 0) AS BIGINT), l.floor, lower(l.address))
      ELSE 'own ' || l.external_id END"""
TOP_SQL = f"""
, site AS (
  SELECT c.user_id, c.districts AS wanted, l.*, {PRINT} AS print FROM v_criteria c JOIN v_listings l ON c.city = l.city
  WHERE (c.rooms IS NULL OR l.rooms IS NULL OR list_contains(c.rooms, l.rooms))
    AND l.price_kzt BETWEEN c.min_price_kzt AND c.max_price_kzt
    AND (l.area_m2 IS NULL OR l.area_m2 BETWEEN c.min_area_m2 AND c.max_area_m2)
    AND (NOT c.owner_only OR l.posted_by = 'owner')),
firsts AS (SELECT user_id, print, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_shipdate)) AS place
  FROM site GROUP BY 1, 2),
cheapest AS (
  SELECT * FROM site QUALIFY row_number() OVER (PARTITION BY user_id, print ORDER BY price_kzt, {POS_SQL}) = 1),
fit AS (
  SELECT c.*, f.place FROM cheapest c JOIN firsts f ON c.user_id = f.user_id AND c.print = f.print
  WHERE wanted IS NULL OR list_contains(wanted, district)),
top AS (
  SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY place.a, place.b, place.c, place.d, place.e) AS rank
  FROM fit QUALIFY rank <= 6),
carded AS (
  SELECT *, price_kzt / area_m2 AS ppm2,
    avg(price_kzt / area_m2) OVER (PARTITION BY user_id) AS batch_avg,
    count(price_kzt / area_m2) OVER (PARTITION BY user_id) AS batch_count
  FROM top),
judged AS (
  SELECT *,
    CASE WHEN ppm2 IS NULL THEN NULL WHEN market_diff_percent IS NOT NULL THEN 'market'
      WHEN batch_count >= 2 THEN 'batch' END AS basis,
    CASE WHEN market_diff_percent IS NOT NULL THEN CAST(abs(round_even(market_diff_percent, 0)) AS BIGINT)
      ELSE CAST(abs(round_even((ppm2 - batch_avg) / batch_avg * 100, 0)) AS BIGINT) END AS pct,
    CASE WHEN market_diff_percent IS NOT NULL THEN market_diff_percent ELSE ppm2 - batch_avg END AS side
  FROM carded)
"""
JUDGED_COLS = """basis,
  CASE WHEN basis IS NULL THEN NULL WHEN pct < (CASE basis WHEN 'market' THEN 1 ELSE 3 END) THEN 'level'
    WHEN side < 0 THEN 'cheaper' ELSE 'dearer' END AS word,
  CASE WHEN basis IS NOT NULL THEN pct END AS percent"""


def _top(v):
    top = m.first_flats(v.criteria, v.listings, POS, scratch.folder(v.spark, "flats"))
    return m.with_listing(top, v.listings)


def w4(v):
    return _top(v).select("user_id", "rank", "external_id")


def w14(v):
    out = s.with_batch_comparison(_top(v), ["user_id"])
    return out.select("user_id", "external_id", F.round("batch_avg", 2).alias("batch_avg"), "batch_count")


def p24(v):
    out = s.with_batch_comparison(_top(v), ["user_id"])
    return out.select(
        "user_id", "external_id", F.col("verdict.basis").alias("basis"), F.col("verdict.word").alias("word"),
        F.col("verdict.percent").alias("percent"),
    )


def a1(v):
    stats = s.batch_price_stats(v.listings, ["city", "district", "rooms"])
    return stats.select(
        "city", "district", "rooms",
        F.round("avg_ppm2", 2).alias("avg_ppm2"), F.round("min_ppm2", 4).alias("min_ppm2"),
        F.round("max_ppm2", 4).alias("max_ppm2"), "priced",
    )


def p21(v):
    return v.listings.select(
        "external_id", money.days_on_market("published_at", now()).alias("days_on_market")
    )


def p22(v):
    return v.listings.select(
        "external_id", F.round(money.price_per_m2("price_kzt", "area_m2"), 4).alias("ppm2")
    )


def p23(v):
    ppm2 = money.price_per_m2("price_kzt", "area_m2")
    return v.listings.select(
        "external_id",
        F.rint(money.city_average(ppm2, F.col("market_diff_percent") * 12)).cast("bigint").alias("city_avg"),
    )


def p25(v):
    return v.listings.select(
        "external_id", money.scorer_market("market_diff_percent").alias("market_text")
    )


CHECKS = {
    "L1_criteria_listing_match": (l1, sql("SELECT user_id, external_id, city, price_kzt FROM v_pairs", "v_pairs")),
    "F1_preview_filter": (
        f1,
        sql(
            """SELECT c.user_id, count(*) AS n, CAST(sum(l.price_kzt) AS BIGINT) AS total_price
FROM v_criteria c JOIN v_listings l ON c.city = l.city
WHERE (c.rooms IS NULL OR l.rooms IS NULL OR list_contains(c.rooms, l.rooms))
  AND l.price_kzt BETWEEN c.min_price_kzt AND c.max_price_kzt
  AND (l.area_m2 IS NULL OR l.area_m2 BETWEEN c.min_area_m2 AND c.max_area_m2)
  AND (NOT c.owner_only OR l.posted_by = 'owner') GROUP BY 1""",
            "v_criteria",
            "v_listings",
        ),
    ),
    "F2_district_tri_state": (
        f2,
        sql(
            """SELECT external_id, CASE WHEN l_orderkey % 2 <> 0 THEN 'match' WHEN l_orderkey % 4 <> 0 THEN 'mismatch'
  WHEN l_partkey % 5 = 0 THEN 'unknown' WHEN district IN ('A', 'N') THEN 'match' ELSE 'mismatch' END AS verdict
FROM v_listings""",
            "v_listings",
        ),
    ),
    "F3_detail_filter_strict": (
        f3,
        sql(
            """SELECT user_id, count(*) AS n FROM v_pairs
WHERE want_districts IS NULL OR l_partkey % 5 <> 0 GROUP BY 1""",
            "v_pairs",
        ),
    ),
    "F4_site_filters": (
        f4,
        sql(
            "SELECT city, count(*) AS n, min(price_kzt) AS cheapest FROM v_listings WHERE posted_by = 'owner' GROUP BY 1",
            "v_listings",
        ),
    ),
    "W2_first_per_id": (
        w2,
        sql(
            f"""SELECT city, CAST(l_partkey AS VARCHAR) AS external_id, price_kzt, l_orderkey FROM v_listings
QUALIFY row_number() OVER (PARTITION BY city, l_partkey ORDER BY {POS_SQL}) = 1""",
            "v_listings",
        ),
    ),
    "W3_clone_collapse": (
        w3,
        _with(W3_BODY + "SELECT external_id, city, price_kzt, place_order, place_line FROM collapsed", "v_listings"),
    ),
    "W4_per_user_cap": (
        w4,
        _with(TOP_SQL + "SELECT user_id, rank, external_id FROM top", "v_listings", "v_criteria"),
    ),
    "W14_batch_comparison": (
        w14,
        _with(
            TOP_SQL + "SELECT user_id, external_id, round(batch_avg, 2) AS batch_avg, batch_count FROM carded",
            "v_listings", "v_criteria",
        ),
    ),
    "P24_price_verdict": (
        p24,
        _with(TOP_SQL + f"SELECT user_id, external_id, {JUDGED_COLS} FROM judged", "v_listings", "v_criteria"),
    ),
    "flagship_top_listings": (
        flagship,
        _with(
            TOP_SQL
            + f"""SELECT user_id, rank, external_id, price_kzt, round(ppm2, 2) AS ppm2,
  round(batch_avg, 2) AS batch_avg, batch_count, {JUDGED_COLS} FROM judged""",
            "v_listings", "v_criteria",
        ),
    ),
    "A1_batch_price_stats": (
        a1,
        sql(
            """SELECT city, district, rooms, CASE WHEN n >= 2 THEN round(a, 2) END AS avg_ppm2,
  CASE WHEN n >= 2 THEN round(lo, 4) END AS min_ppm2, CASE WHEN n >= 2 THEN round(hi, 4) END AS max_ppm2, n AS priced
FROM (SELECT city, district, rooms, avg(price_kzt / area_m2) AS a, min(price_kzt / area_m2) AS lo,
  max(price_kzt / area_m2) AS hi, count(area_m2) AS n FROM v_listings GROUP BY ALL)""",
            "v_listings",
        ),
    ),
    "P21_days_on_market": (
        p21,
        sql(
            f"""SELECT external_id, greatest(date_diff('day', published_at, TIMESTAMP '{NOW}'), 0) AS days_on_market
FROM v_listings""",
            "v_listings",
        ),
    ),
    "P22_price_per_m2": (
        p22,
        sql("SELECT external_id, round(price_kzt / area_m2, 4) AS ppm2 FROM v_listings", "v_listings"),
    ),
    "P23_city_average": (
        p23,
        sql(
            """SELECT external_id, CASE WHEN 1 + market_diff_percent * 12 / 100 > 0 THEN
  CAST(round_even(price_kzt / area_m2 / (1 + market_diff_percent * 12 / 100), 0) AS BIGINT) END AS city_avg
FROM v_listings""",
            "v_listings",
        ),
    ),
    "P25_scorer_market_text": (
        p25,
        sql(
            """SELECT external_id, CASE WHEN market_diff_percent IS NULL THEN 'unknown'
  WHEN abs(market_diff_percent) < 1 THEN 'at city market'
  ELSE CAST(abs(round_even(market_diff_percent, 0)) AS BIGINT) || '% ' ||
    CASE WHEN market_diff_percent < 0 THEN 'cheaper' ELSE 'pricier' END || ' than city' END AS market_text
FROM v_listings""",
            "v_listings",
        ),
    ),
}
