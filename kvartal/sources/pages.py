"""Crawled pages and the plan of pages to crawl."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.sources import catalog as cat

PAGES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("page_no", T.LongType()),
    ]
)


def read(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Pages from parquet, as a table or as a stream of new files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(PAGES).parquet(path)


def conform(rows: DataFrame) -> DataFrame:
    """Any table with some of the page columns in the page schema."""
    have = set(rows.columns)
    return rows.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in PAGES.fields
        ]
    )


def _pair(name: str, value: Column) -> Column:
    """One encoded query parameter, null when the value is."""
    return F.concat(F.url_encode(F.lit(name)), F.lit("="), F.url_encode(value))


def _short(number: Column) -> Column:
    """A number the way ``%g`` prints it: six digits, no trailing zeros."""
    six = F.call_function("format_string", F.lit("%.6g"), number)
    whole = F.regexp_replace(F.regexp_replace(six, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(number.isNotNull(), whole)


def crawl_plan(criteria: DataFrame, catalog: DataFrame, base_url: str) -> DataFrame:
    """One url per user and page 1..page_limit; an error row without a slug.

    Districts are no parameter of the site; they are filtered afterwards.
    """
    slugs = cat.cities(catalog).select(F.col("canonical").alias("city"), "slug")
    rows = criteria.join(slugs, "city", "left")
    pages = F.when(F.col("slug").isNull(), F.array(F.lit(None).cast("int"))).otherwise(
        F.sequence(F.lit(1), F.col("page_limit"))
    )
    rows = rows.withColumn("page", F.explode(pages))
    segment = F.when(F.col("deal_type") == "sale", F.lit("prodazha")).otherwise(F.lit("arenda"))
    term = F.when(F.col("rent_period") == "daily", F.lit("1")).when(F.col("rent_period") == "hourly", F.lit("4"))
    rooms = F.transform("rooms", lambda r: _pair("das[live.rooms][]", r.cast("string")))
    params = F.concat(
        F.array(
            _pair("page", F.col("page").cast("string")),
            _pair("das[price][from]", F.col("min_price_kzt").cast("string")),
            _pair("das[price][to]", F.col("max_price_kzt").cast("string")),
        ),
        F.coalesce(rooms, F.array().cast("array<string>")),
        F.array(
            _pair("das[live.square][from]", _short(F.col("min_area_m2"))),
            _pair("das[live.square][to]", _short(F.col("max_area_m2"))),
            F.when(F.col("owner_only"), _pair("das[who]", F.lit("1"))),
            F.when(F.col("deal_type") == "rent", _pair("das[rent.period]", term)),
        ),
    )
    url = F.concat(
        F.lit(base_url.rstrip("/") + "/"), segment, F.lit("/kvartiry/"), F.url_encode("slug"), F.lit("/?"),
        F.array_join(F.array_compact(params), "&"),
    )
    return rows.select(
        "user_id",
        "page",
        url.alias("url"),
        F.when(F.col("slug").isNull(), F.lit("city has no slug")).alias("error"),
    )


def in_page_order(rows: DataFrame, page: Sequence[str]) -> DataFrame:
    """``place``: cards of several pages in page order, without a global sort."""
    return rows.withColumn("place", F.struct(*page, "card_pos"))
