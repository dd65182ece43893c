"""Mortgage, nearby places, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Views, sql
from kvartal.operators import enrich as e

RATE_SQL = """CASE WHEN principal <= 0 THEN 0 WHEN rate <= 0 THEN round_even(principal / 240.0, 0)
  ELSE round_even(principal * (rate / 100 / 12) * pow(1 + rate / 100 / 12, 240) / (pow(1 + rate / 100 / 12, 240) - 1), 0) END"""


def p26(v):
    rate = F.when(F.col("l_orderkey") % 4 == 0, 0.0).otherwise(17.5)
    return e.with_mortgage(v.listings, rate).select(
        "external_id", F.col("mortgage_monthly_payment_kzt").alias("monthly"),
        F.col("mortgage_total_overpayment_kzt").alias("overpayment"),
    )


def p27(v):
    rows = v.listings.withColumns(
        {
            "deal_type": F.when(F.col("l_orderkey") % 3 == 0, "rent").otherwise("sale"),
            "price_kzt": F.when(F.col("l_partkey") % 5 == 0, F.lit(0).cast("bigint")).otherwise(F.col("price_kzt")),
        }
    )
    return e.with_mortgage(rows).groupBy("city").agg(
        F.count("mortgage_monthly_payment_kzt").alias("with_mortgage"), F.count(F.lit(1)).alias("n")
    )


def _spots(v: Views):
    """Listings whose address is known to the point table only in trimmed lower case."""
    return v.table("part").select(
        F.col("p_partkey").alias("listing_id"),
        F.when(F.col("p_partkey") % 2 == 0, "ALMATY ").otherwise("astana").alias("city"),
        F.when(
            F.col("p_partkey") % 10 != 9, F.concat(F.lit("street "), F.col("p_partkey").cast("string"))
        ).alias("address"),
    )


SPOTS = """, spots AS (SELECT p_partkey AS listing_id, p_partkey % 2 = 0 AS metro_city,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 10 <> 9 THEN 43 + (p_partkey % 100) / 1000 END AS lat,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 10 <> 9 THEN 76 + (p_partkey % 41) / 1000 END AS lon FROM part),
dist AS (SELECT listing_id, category, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(p.lat - s.lat) / 2), 2)
    + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - s.lon) / 2), 2))) AS m
  FROM spots s JOIN v_pois p ON abs(p.lat - s.lat) < 0.05 AND abs(p.lon - s.lon) < 0.05),
near AS (SELECT listing_id, count(*) FILTER (category = 'school') AS sc, count(*) FILTER (category = 'park') AS pk,
    count(*) FILTER (category = 'metro station') AS mt, round_even(min(m) FILTER (category = 'school'), 0) AS sc_m,
    round_even(min(m) FILTER (category = 'park'), 0) AS pk_m, round_even(min(m) FILTER (category = 'metro station'), 0) AS mt_m
  FROM dist WHERE m <= 2000 GROUP BY 1)
"""


def _with(body: str, *names: str) -> str:
    base = sql("SELECT 1", *names)
    return base[: base.rindex("SELECT 1")] + SPOTS + body


def l14(v):
    out = e.with_nearby(_spots(v), v.address_points, v.pois)
    return out.select(
        "listing_id", "nearby_schools", "nearby_parks", "nearby_metro", "nearby_school_m", "nearby_park_m",
        "nearby_metro_m",
    )


def l15(v):
    out = e.geocode(_spots(v), v.address_points)
    return out.select("listing_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def l17(v):
    out = e.with_nearby(_spots(v), v.address_points, v.pois)
    return out.groupBy(e.place_key("city").alias("city")).agg(
        F.count("nearby_metro").alias("with_metro"), F.count("nearby_schools").alias("with_schools")
    )


def _geo_cache(v):
    """Addresses cached at the time of an order; hits and misses."""
    return v.table("orders").groupBy((F.col("o_orderkey") % 2000).alias("k")).agg(
        F.max("o_orderdate").cast("timestamp").alias("cached_at")
    ).select(
        F.when(F.col("k") % 2 == 0, "almaty").otherwise("astana").alias("city"),
        F.concat(F.lit("street "), F.col("k").cast("string")).alias("address"),
        F.when(F.col("k") % 3 != 0, 43.0).alias("lat"), F.when(F.col("k") % 3 != 0, 76.0).alias("lon"), "cached_at",
    )


CACHE_NOW = "2001-07-20 00:00:00"


def l16(v):
    at = F.lit(CACHE_NOW).cast("timestamp")
    return e.addresses_to_look_up(_spots(v), _geo_cache(v), at)


def l16b(v):
    at = F.lit(CACHE_NOW).cast("timestamp")
    points = v.address_points.withColumn("city", F.lower("city"))
    cache = v.table("orders").groupBy((F.col("o_orderkey") % 100).alias("a"), (F.col("o_orderkey") % 41).alias("b")).agg(
        F.max("o_orderdate").cast("timestamp").alias("cached_at")
    ).select(
        F.lit("school").alias("category"),
        F.concat(F.lit("43."), F.lpad(F.col("a").cast("string"), 3, "0"), F.lit("0")).alias("lat4"),
        F.concat(F.lit("76."), F.lpad(F.col("b").cast("string"), 3, "0"), F.lit("0")).alias("lon4"),
        F.lit(2000).alias("radius_m"), F.when(F.col("a") % 9 != 0, 1).alias("places"), "cached_at",
    )
    return e.counts_to_look_up(points, cache, at)


CHECKS = {
    "P26_mortgage": (
        p26,
        sql(
            f"""SELECT external_id, CAST(monthly AS BIGINT) AS monthly, CAST(greatest(monthly * 240 - principal, 0) AS BIGINT) AS overpayment
FROM (SELECT *, {RATE_SQL} AS monthly FROM (SELECT external_id, CAST(trunc(price_kzt * CAST(0.8 AS DOUBLE)) AS BIGINT) AS principal,
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(17.5 AS DOUBLE) END AS rate FROM v_listings))""",
            "v_listings",
        ),
    ),
    "P27_mortgage_applies": (
        p27,
        sql(
            """SELECT city, count(*) FILTER (l_orderkey % 3 <> 0 AND l_partkey % 5 <> 0 AND price_kzt > 0) AS with_mortgage,
  count(*) AS n FROM v_listings GROUP BY 1""",
            "v_listings",
        ),
    ),
    "L14_nearby_places": (
        l14,
        _with(
            """SELECT s.listing_id, CASE WHEN lat IS NOT NULL THEN coalesce(sc, 0) END AS nearby_schools,
  CASE WHEN lat IS NOT NULL THEN coalesce(pk, 0) END AS nearby_parks,
  CASE WHEN lat IS NOT NULL AND metro_city THEN coalesce(mt, 0) END AS nearby_metro,
  CAST(sc_m AS INT) AS nearby_school_m, CAST(pk_m AS INT) AS nearby_park_m,
  CASE WHEN metro_city THEN CAST(mt_m AS INT) END AS nearby_metro_m
FROM spots s LEFT JOIN near n ON n.listing_id = s.listing_id""",
            "v_pois",
        ),
    ),
    "L15_geocode": (
        l15,
        _with("SELECT listing_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM spots", "v_pois"),
    ),
    "L17_metro_cities": (
        l17,
        _with(
            """SELECT CASE WHEN metro_city THEN 'almaty' ELSE 'astana' END AS city,
  count(*) FILTER (lat IS NOT NULL AND metro_city) AS with_metro, count(lat) AS with_schools FROM spots GROUP BY 1""",
            "v_pois",
        ),
    ),
    "L16_addresses_to_look_up": (
        l16,
        f"""SELECT CASE WHEN p_partkey % 2 = 0 THEN 'almaty' ELSE 'astana' END AS city, 'street ' || p_partkey AS address
FROM part LEFT JOIN (SELECT o_orderkey % 2000 AS k, max(o_orderdate) AS cached FROM orders GROUP BY 1) ON k = p_partkey
WHERE p_partkey % 10 <> 9 AND NOT coalesce(cached + INTERVAL 1 DAY * (CASE WHEN k % 3 = 0 THEN 1 ELSE 30 END) > TIMESTAMP '{CACHE_NOW}', false)""",
    ),
    "L16_counts_to_look_up": (
        l16b,
        f"""WITH pts AS (SELECT DISTINCT p_partkey % 100 AS a, p_partkey % 41 AS b, p_partkey % 2 = 0 AS metro FROM part WHERE p_partkey % 7 <> 0),
keys AS (SELECT DISTINCT category, a, b FROM (SELECT unnest(['school', 'park']) AS category, a, b FROM pts
  UNION ALL SELECT 'metro station', a, b FROM pts WHERE metro))
SELECT category, '43.' || lpad(CAST(k.a AS VARCHAR), 3, '0') || '0' AS lat4, '76.' || lpad(CAST(k.b AS VARCHAR), 3, '0') || '0' AS lon4
FROM keys k LEFT JOIN (SELECT o_orderkey % 100 AS a, o_orderkey % 41 AS b, max(o_orderdate) AS cached FROM orders GROUP BY ALL) c
  ON c.a = k.a AND c.b = k.b AND category = 'school' AND c.a % 9 <> 0 AND cached + INTERVAL 7 DAY > TIMESTAMP '{CACHE_NOW}'
WHERE c.a IS NULL""",
    ),
}
