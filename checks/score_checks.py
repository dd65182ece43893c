"""Scoring requests and responses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.views import NOW, POS, POS_SQL, now, sql
from kvartal.operators import score as s


def _batches(v):
    """Every order is a batch; positions follow the listing order."""
    w = Window.partitionBy("l_orderkey").orderBy(*POS)
    nothing = ["nearby_metro", "nearby_metro_m", "build_year", "building_type", "ceiling_height_m", "furnished", "condition"]
    rows = v.listings.withColumn("position", F.row_number().over(w)).withColumns(
        {
            "nearby_schools": (F.col("l_partkey") % 4).cast("int"),
            "nearby_school_m": F.when(F.col("l_partkey") % 4 > 0, F.col("l_suppkey") * 10).cast("int"),
            "nearby_parks": F.lit(0),
            "nearby_park_m": F.lit(None).cast("int"),
            "mortgage_monthly_payment_kzt": F.col("price_kzt") % 3,
            "description": F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" a \n b "), F.col("address"))),
        }
    )
    return rows.withColumns({c: F.lit(None).cast("string") for c in nothing})


def a12(v):
    return s.request_batches(_batches(v), ["l_orderkey"], now())


def _responses(v):
    """One JSON response per order; items of line 6 are left out, some are invalid."""
    line = v.table("lineitem")
    item = F.to_json(
        F.struct(
            F.col("l_linenumber").alias("index"),
            F.rint(F.col("l_discount") * 2000).alias("score"),
            F.when(F.col("l_discount") >= 0.08, "strong_buy").when(F.col("l_discount") >= 0.02, "consider")
            .otherwise(F.col("l_returnflag")).alias("recommendation"),
            F.array(F.col("l_returnflag")).alias("reasons"),
            F.when(F.col("l_tax") > 0.04, F.concat(F.lit(" s"), F.col("l_partkey"), F.lit(" "))).alias("summary"),
        )
    )
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", item.alias("item"))
    kept = line.where(F.col("l_linenumber") != 6)
    grouped = kept.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(at)).alias("items"))
    body = F.concat(
        F.lit('{"items": ['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}")
    )
    return grouped.select("l_orderkey", body.alias("content"))


def l18(v):
    scores = s.parse_scores(_responses(v), ["l_orderkey"])
    return scores.select(
        "l_orderkey", "position", "score", "recommendation", F.array_join("reasons", ",").alias("reasons"),
        "description_summary",
    )


def w5(v):
    scores = s.parse_scores(_responses(v), ["l_orderkey"])
    items = v.listings.groupBy("l_orderkey", F.col("l_linenumber").alias("position")).agg(F.min("external_id").alias("external_id"))
    ranked = s.rank_by_score(s.attach_scores(items, scores, ["l_orderkey"]), ["l_orderkey"])
    return ranked.select("l_orderkey", "position", "external_id", "score", "rank")


VALID = """, valid AS (SELECT l_orderkey, l_linenumber AS position, round_even(l_discount * 2000, 0) AS score,
  CASE WHEN l_discount >= 0.08 THEN 'strong_buy' ELSE 'consider' END AS recommendation, l_returnflag AS reasons,
  CASE WHEN l_tax > 0.04 THEN 's' || l_partkey END AS description_summary, l_partkey, l_suppkey, l_shipdate
FROM lineitem WHERE l_linenumber <> 6 AND l_discount >= 0.02 AND round_even(l_discount * 2000, 0) BETWEEN 0 AND 100),
last AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY l_orderkey, position
  ORDER BY l_partkey DESC, l_suppkey DESC, l_shipdate DESC) = 1)
"""


def _with(body: str) -> str:
    base = sql("SELECT 1", "v_listings")
    return base[: base.rindex("SELECT 1")] + VALID + body


CHECKS = {
    "A12_scoring_request": (
        a12,
        sql(
            f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {POS_SQL}) AS position,
  CAST(round_even(price_kzt / area_m2, 0) AS BIGINT) AS ppm2, price_kzt / area_m2 AS raw FROM v_listings)
SELECT l_orderkey, count(*) AS listings,
  CASE WHEN count(raw) >= 2 THEN 'listings: ' || count(*) || ', price_per_m2 avg=' || CAST(round_even(avg(raw), 0) AS BIGINT)
    || ', min=' || min(ppm2) || ', max=' || max(ppm2) END AS stats_line,
  string_agg('[' || position || '] price_kzt=' || price_kzt || ', price_per_m2=' || coalesce(CAST(ppm2 AS VARCHAR), 'unknown')
    || ', rooms=' || coalesce(CAST(rooms AS VARCHAR), 'unknown') || ', area_m2=' || coalesce(CAST(area_m2 AS VARCHAR), 'unknown')
    || ', floor=' || floor || ', district=' || district || ', schools=' || (l_partkey % 4)
    || CASE WHEN l_partkey % 4 > 0 THEN ' (nearest ' || (l_suppkey * 10) || 'm)' ELSE '' END
    || ', parks=0, metro=unknown, posted_by=' || posted_by
    || ', build_year=unknown, building_type=unknown, ceiling_m=unknown, furnished=unknown, condition=unknown, vs_city_market='
    || CASE WHEN market_diff_percent IS NULL THEN 'unknown' WHEN abs(market_diff_percent) < 1 THEN 'at city market'
      ELSE CAST(abs(round_even(market_diff_percent, 0)) AS BIGINT) || '% ' ||
        CASE WHEN market_diff_percent < 0 THEN 'cheaper' ELSE 'pricier' END || ' than city' END
    || ', days_on_market=' || greatest(date_diff('day', published_at, TIMESTAMP '{NOW}'), 0)
    || ', mortgage_monthly_kzt=' || CASE WHEN price_kzt % 3 = 0 THEN 'unknown' ELSE CAST(price_kzt % 3 AS VARCHAR) END
    || CASE WHEN l_partkey % 3 = 0 THEN chr(10) || '    описание: a b ' || address ELSE '' END, chr(10) ORDER BY position) AS listing_lines
FROM b GROUP BY 1""",
            "v_listings",
        ),
    ),
    "L18_attach_scores": (
        l18,
        _with("SELECT l_orderkey, position, score, recommendation, reasons, description_summary FROM last"),
    ),
    "W5_rank_by_score": (
        w5,
        _with(
            """SELECT i.l_orderkey, i.position, i.external_id, l.score,
  row_number() OVER (PARTITION BY i.l_orderkey ORDER BY l.score DESC NULLS LAST, i.position) AS rank
FROM (SELECT l_orderkey, l_linenumber AS position, min(external_id) AS external_id FROM v_listings GROUP BY ALL) i
LEFT JOIN last l ON l.l_orderkey = i.l_orderkey AND l.position = i.position"""
        ),
    ),
}
