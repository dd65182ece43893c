"""Nearby places, geocoding against tables, mortgage estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions import geo, money
from kvartal.functions import text as tx
from kvartal.operators.skew import ROWS_PER_SPLIT, salted_join

RADIUS_M = 2000
POINT_TTL_DAYS = 30
MISS_TTL_DAYS = 1
COUNT_TTL_DAYS = 7
CATEGORIES = {"school": "school", "park": "park", "metro station": "metro"}
# Cities that have a metro.
METRO_CITIES = ("almaty", "алматы")


def place_key(c: Column | str) -> Column:
    return F.lower(tx.strip(c))


def four_decimals(c: Column | str) -> Column:
    """Coordinate text of a cached count (about eleven metres)."""
    return F.call_function("format_number", tx.col(c), F.lit("0.0000"))


def has_metro(city: Column | str) -> Column:
    return place_key(city).isin(*METRO_CITIES)


def with_mortgage(listings: DataFrame, rate: Column | float = money.ANNUAL_RATE) -> DataFrame:
    """Monthly payment and overpayment; null for a rent or without a price."""
    applies = (F.col("deal_type") != "rent") & (F.col("price_kzt") > 0)
    loan = money.principal("price_kzt")
    monthly = money.monthly_payment(loan, rate)
    return listings.withColumns(
        {
            "mortgage_monthly_payment_kzt": F.when(applies, monthly),
            "mortgage_total_overpayment_kzt": F.when(applies, money.overpayment(loan, monthly)),
        }
    )


def geocode(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Point of (city, address) by trimmed lower-case key; unknown gives null."""
    keyed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        place_key("city").alias("__city"), place_key("address").alias("__address"), "lat", "lon"
    )
    one = keyed.groupBy("__city", "__address").agg(F.min(F.struct("lat", "lon")).alias("__p"))
    one = one.select("__city", "__address", "__p.lat", "__p.lon")
    marked = rows.withColumns({"__city": place_key("city"), "__address": place_key("address")})
    return _left_join(marked, one, ["__city", "__address"]).drop("__city", "__address")


def _left_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which rows without a key pass by, not all through one task."""
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    found = rows.where(known).join(table, keys, "left")
    rest = rows.where(~known).withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema.fields if f.name not in keys})
    return found.unionByName(rest)


def nearby(
    points: DataFrame,
    pois: DataFrame,
    radius_m: float = RADIUS_M,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Places within the radius of every distinct point, per category.

    A point lies in one grid cell; a place is copied to the nine cells it can
    reach, so the join is an equi join on the cell and the distance is tested
    only inside. Counts are pre-aggregated in the join's own tasks. Rows exist
    only for categories with a hit.
    """
    row = geo.lat_row(F.col("lat"), radius_m)
    spots = points.select("lat", "lon").distinct().withColumn("__row", row)
    spots = spots.withColumn("__col", geo.lon_col(F.col("lon"), F.col("__row"), radius_m))
    around = F.sequence(F.lit(-1), F.lit(1))
    places = (
        pois.select("category", F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
        .withColumn("__dr", F.explode(around))
        .withColumn("__row", geo.lat_row(F.col("__lat"), radius_m) + F.col("__dr"))
        .withColumn("__dc", F.explode(around))
        .withColumn("__col", geo.lon_col(F.col("__lon"), F.col("__row"), radius_m) + F.col("__dc"))
        .drop("__dr", "__dc")
    )
    distance = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
    near = salted_join(spots, places, ["__row", "__col"], ["lat", "lon"], None, rows_per_split)
    near = near.withColumn("__m", distance).where(F.col("__m") <= radius_m)
    return near.groupBy("lat", "lon", "category").agg(
        F.count(F.lit(1)).alias("places"), F.rint(F.min("__m")).cast("int").alias("nearest_m")
    )


def with_nearby(listings: DataFrame, points: DataFrame, pois: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Counts and nearest metres per category on every listing.

    No point: everything null (unknown). A point without places: 0 and null.
    Metro stays null where there is no metro.
    """
    located = geocode(listings, points)
    hits = nearby(located.where(F.col("lat").isNotNull()), pois, radius_m)
    wide = hits.groupBy("lat", "lon").agg(
        *[
            F.max(F.when(F.col("category") == kind, F.col(source))).alias(f"__{name}_{source}")
            for kind, name in CATEGORIES.items()
            for source in ("places", "nearest_m")
        ]
    )
    out = _left_join(located, wide, ["lat", "lon"])
    known = F.col("lat").isNotNull()
    plural = {"school": "nearby_schools", "park": "nearby_parks", "metro": "nearby_metro"}
    columns: dict[str, Column] = {}
    for name in CATEGORIES.values():
        asked = known & has_metro("city") if name == "metro" else known
        columns[plural[name]] = F.when(asked, F.coalesce(F.col(f"__{name}_places"), F.lit(0))).cast("int")
        columns[f"nearby_{name}_m"] = F.when(asked, F.col(f"__{name}_nearest_m"))
    return out.withColumns(columns).drop(*[c for c in out.columns if c.startswith("__")])


def addresses_to_look_up(listings: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Distinct (city, address) keys with no fresh cache row.

    Cache: city, address (keys), lat, lon (null for a miss), cached_at.
    """
    wanted = (
        listings.where(tx.blank_to_null("address").isNotNull())
        .select(place_key("city").alias("city"), place_key("address").alias("address"))
        .distinct()
    )
    days = F.when(F.col("lat").isNull(), MISS_TTL_DAYS).otherwise(POINT_TTL_DAYS)
    fresh = cache.where(F.col("cached_at") + F.make_dt_interval(days) > now)
    return wanted.join(fresh.select("city", "address"), ["city", "address"], "left_anti")


def counts_to_look_up(
    points: DataFrame, cache: DataFrame, now: Column, radius_m: int = RADIUS_M
) -> DataFrame:
    """Distinct (category, lat4, lon4) keys with no fresh cached count."""
    kinds = F.array(*[F.lit(k) for k in CATEGORIES])
    asked = points.where(F.col("lat").isNotNull()).select(
        F.explode(
            F.when(has_metro("city"), kinds).otherwise(
                F.filter(kinds, lambda k: k != F.lit("metro station"))
            )
        ).alias("category"),
        four_decimals("lat").alias("lat4"),
        four_decimals("lon").alias("lon4"),
    )
    fresh = cache.where(
        (F.col("radius_m") == radius_m)
        & F.col("places").isNotNull()
        & (F.col("cached_at") + F.make_dt_interval(F.lit(COUNT_TTL_DAYS)) > now)
    )
    keys = ["category", "lat4", "lon4"]
    return asked.distinct().join(fresh.select(*keys), keys, "left_anti")
