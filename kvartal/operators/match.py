"""Criteria against listings: filters, clone collapse, per-user cap."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.functions import text as tx

MAX_RESULTS = 6
BAND_RATIO = 1.5
MAX_PRICE = 10**13
#: Listings of the first slice of a search that stops early; each later slice holds so many times more.
FIRST_SLICE = 16_384
SLICE_GROWTH = 8


def _known_within(value: Column, low: Column, high: Column) -> Column:
    """Range test that lets an unknown value or an open bound pass."""
    above = F.coalesce(value >= low, F.lit(True))
    below = F.coalesce(value <= high, F.lit(True))
    return above & below


def rooms_fit(rooms: Column, wanted: Column) -> Column:
    return F.coalesce(F.array_contains(wanted, rooms), F.lit(True)) | (
        F.coalesce(F.size(wanted), F.lit(0)) <= 0
    )


def preview_fit(prefix: str = "") -> Column:
    """Rooms, price and area filter; unknown listing values pass."""
    return (
        rooms_fit(F.col("rooms"), F.col("want_rooms"))
        & _known_within(F.col("price_kzt"), F.col("min_price_kzt"), F.col("max_price_kzt"))
        & _known_within(F.col("area_m2"), F.col("min_area_m2"), F.col("max_area_m2"))
    )


def district_match(found: Column, asked: Column, wanted: Column) -> Column:
    """match, mismatch or unknown.

    ``asked`` are the districts as requested, ``wanted`` those that resolved in
    the city. A request of which nothing resolved matches no listing.
    """
    return (
        F.when(F.coalesce(F.size(asked), F.lit(0)) <= 0, F.lit("match"))
        .when(F.coalesce(F.size(wanted), F.lit(0)) <= 0, F.lit("mismatch"))
        .when(found.isNull(), F.lit("unknown"))
        .when(F.array_contains(wanted, found), F.lit("match"))
        .otherwise(F.lit("mismatch"))
    )


def site_fit() -> Column:
    """Deal, rent term and poster, which the crawled site filters itself."""
    period = F.coalesce(F.col("want_rent_period"), F.lit("monthly"))
    return (
        (F.col("deal_type") == F.col("want_deal_type"))
        & (
            (F.col("deal_type") != "rent")
            | (F.coalesce(F.col("rent_period"), F.lit("monthly")) == period)
        )
        & (~F.coalesce(F.col("owner_only"), F.lit(False)) | F.coalesce(F.col("posted_by") == "owner", F.lit(False)))
    )


def price_band(price: Column) -> Column:
    """Index of the geometric price band; rises with the price."""
    band = F.floor(F.log(F.greatest(price.cast("double"), F.lit(1.0))) / math.log(BAND_RATIO))
    return F.when(price.isNotNull(), band.cast("int"))


TOP_BAND = math.floor(math.log(MAX_PRICE) / math.log(BAND_RATIO))


def _asked(criteria: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per request and price band that it covers, band -1 (no price) included."""
    asked = criteria.select(
        "user_id",
        "city",
        "deal_type",
        F.col("rent_period").alias("want_rent_period"),
        F.col("deal_type").alias("want_deal_type"),
        "min_price_kzt",
        "max_price_kzt",
        F.col("rooms").alias("want_rooms"),
        F.col("districts").alias("want_districts"),
        F.col("district_keys").alias("want_district_keys"),
        "min_area_m2",
        "max_area_m2",
        "owner_only",
        *carry,
    )
    low = F.least(F.coalesce(price_band(F.col("min_price_kzt")), F.lit(0)), F.lit(TOP_BAND))
    high = F.least(F.coalesce(price_band(F.col("max_price_kzt")), F.lit(TOP_BAND)), F.lit(TOP_BAND))
    bands = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return asked.withColumn("__band", F.explode(F.array_append(bands, F.lit(-1))))


def match(
    criteria: DataFrame,
    listings: DataFrame,
    strict_district: bool = False,
    carry: Sequence[str] = (),
    any_district: bool = False,
) -> DataFrame:
    """Every (user, listing) pair that fits; ``any_district`` leaves the district out.

    The price range is turned into the short list of geometric bands it covers,
    a listing lies in exactly one band, and the join is an equi join on city,
    deal and band; only pairs of one band meet the exact test. Where a band of a
    big city is hot, Spark's skew join cuts both sides by their measured size, so a
    task meets a part of the listings with a part of the requests. A listing
    without a price lies in a band of its own (-1) that every request probes.

    Criteria: user_id, city, deal_type, rent_period, min/max_price_kzt,
    rooms, districts, district_keys, min/max_area_m2, owner_only. Listings:
    the listing columns and district_key. ``carry`` names further criteria
    columns to keep on the pairs.
    """
    offered = listings.withColumn(
        "__band",
        F.when(
            F.col("price_kzt").isNotNull(),
            F.least(price_band(F.col("price_kzt")), F.lit(TOP_BAND)),
        ).otherwise(F.lit(-1)),
    )
    found = _district_verdict()
    district_ok = F.lit(True) if any_district else found == "match" if strict_district else found != "mismatch"
    pairs = offered.join(_asked(criteria, carry), ["city", "deal_type", "__band"])
    return pairs.where(preview_fit() & district_ok & site_fit()).drop("__band", "want_deal_type")


def _district_verdict() -> Column:
    return district_match(F.col("district_key"), F.col("want_districts"), F.col("want_district_keys"))


def flats(
    criteria: DataFrame, listings: DataFrame, order: Sequence[str], strict_district: bool = True
) -> DataFrame:
    """Distinct flats of every user's result: user_id, external_id, place and flat.

    The site filters come first; then the clones inside one user's result collapse to
    the cheapest, at the place of the first; then the district of what is left counts.
    So a flat that an agent and its owner post is the owner's for a user who wants
    owners only. Pairs are narrow until the cut, and those of flats posted once are
    never shuffled before it: payload is joined afterwards (``with_listing``). ``flat`` identifies the flat across its clones.
    """
    return _distinct(criteria, _offers(listings, order), strict_district)


def _offers(listings: DataFrame, order: Sequence[str]) -> DataFrame:
    """What a match needs of the listings; ``again`` is the first place of a flat that is posted again."""
    rest = ["external_id", "city", "deal_type", "rent_period", "price_kzt", "rooms", "area_m2", "posted_by", "district_key"]
    own = F.concat(F.lit("id "), "external_id")
    narrow = listings.select(
        *rest, F.struct(*order).alias("place"), F.coalesce(F.to_json(fingerprint()), own).alias("flat")
    )
    # most flats are posted once: their pairs need no collapse and go straight to the cut
    flat = narrow.groupBy("city", "deal_type", "flat").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("again"))
    return narrow.join(flat.where("n > 1").drop("n"), ["city", "deal_type", "flat"], "left")


def _distinct(criteria: DataFrame, marked: DataFrame, strict_district: bool) -> DataFrame:
    single = match(criteria, marked.where(F.col("again").isNull()), any_district=True).select(
        "user_id", "external_id", "place", "flat", _district_verdict().alias("district")
    )
    best = F.struct(
        F.col("price_kzt").isNull().alias("no_price"), "price_kzt", F.col("place").alias("at"), "external_id",
        _district_verdict().alias("district"),
    ).alias("row")
    clones = match(criteria, marked.where(F.col("again").isNotNull()), any_district=True).select("user_id", "flat", "place", best)
    merged = clones.groupBy("user_id", "flat").agg(F.min("row").alias("row"), F.min("place").alias("place"))
    rows = single.unionByName(merged.select("user_id", "row.external_id", "place", "flat", "row.district"))
    fit = F.col("district") == "match" if strict_district else F.col("district") != "mismatch"
    return rows.where(fit).drop("district")


def slices(rows: DataFrame, lead: str) -> list[Column]:
    """Tests that cut ``rows`` into ascending ranges of ``lead``, the first one short, each next one longer.

    Rows of one value stay together, null comes first. ``lead`` is a number, a date or a time;
    other types are not cut. The driver sees a count and the bounds.
    """
    kind, total = rows.schema[lead].dataType, rows.count()
    shares, share = [], FIRST_SLICE / max(total, 1)
    while share < 1:
        shares.append(share)
        share *= SLICE_GROWTH
    if not shares or not isinstance(kind, T.NumericType | T.DateType | T.TimestampType):
        return [F.lit(True)]
    at = F.unix_micros(lead) if isinstance(kind, T.TimestampType) else F.unix_date(lead) if isinstance(kind, T.DateType) else F.col(lead)
    bounds = sorted(set(rows.agg(F.percentile_approx(at, shares).alias("b")).first().b or []))
    if not bounds:
        return [F.lit(True)]
    first = at.isNull() | (at <= bounds[0])
    between = [(at > low) & (at <= high) for low, high in zip(bounds, bounds[1:], strict=False)]
    return [first, *between, at > bounds[-1]]


def first_flats(
    criteria: DataFrame,
    listings: DataFrame,
    order: Sequence[str],
    work: str,
    limit: int = MAX_RESULTS,
    strict_district: bool = True,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """The first ``limit`` of every user's ``flats`` that ``keep`` leaves, with ``rank``.

    Flats are met in slices by their first place, all clones of a flat in one slice. No later
    slice holds a place before the slice's end, so a user with ``limit`` flats up to there is
    done; only the others meet the next slice. So a user meets as many listings as it takes to
    find the flats, and no table of all fitting pairs is made. Rounds are written to ``work``, a
    shared folder; all the driver sees is the bounds and whether anyone is left.
    """
    spark = criteria.sparkSession

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{work}/{name}")

    offers = _offers(listings, order).withColumn("lead", F.coalesce("again", "place")[order[0]])
    offers = stored(offers, "offers")
    cuts = slices(offers, "lead")
    open_, found, done = criteria, None, []
    for turn, cut in enumerate(cuts):
        rows = keep(_distinct(open_, offers.where(cut), strict_district))
        if found is not None:
            rows = rows.unionByName(found.select(*rows.columns))
        top = stored(top_per_user(rows, ["place"], limit), f"top-{turn}")
        if turn == len(cuts) - 1:
            return _union([*done, top])
        passed = top.withColumn("lead", F.col("place")[order[0]]).where(~_any(cuts[turn + 1 :]))
        full = stored(passed.groupBy("user_id").count().where(F.col("count") >= limit).select("user_id"), f"full-{turn}")
        done.append(top.join(full, "user_id", "left_semi"))
        found = top.join(full, "user_id", "left_anti").drop("rank")
        open_ = open_.join(full, "user_id", "left_anti")
        if open_.isEmpty():
            break
    return _union(done)


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def with_listing(rows: DataFrame, listings: DataFrame) -> DataFrame:
    """Payload of the few rows that are left."""
    return rows.join(listings, "external_id")


def detail_fit() -> Column:
    """The same filter after the detail page; here the district must be known."""
    found = district_match(
        F.col("district_key"), F.col("want_districts"), F.col("want_district_keys")
    )
    return preview_fit() & (found == "match")


def first_per_id(previews: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop repeats of an external id inside a scan; the first one stays."""
    rest = [c for c in previews.columns if c not in (*scope, "external_id")]
    best = previews.groupBy(*scope, "external_id").agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    )
    return best.select(*scope, "external_id", "__row.*").select(*previews.columns)


def fingerprint() -> Column:
    """Identity of the flat itself; null when a part is missing.

    A street without a house number is not an identity, so the address must
    hold a digit. The area is compared at one decimal.
    """
    address = F.lower(tx.strip(tx.squeeze("address")))
    complete = (
        F.col("rooms").isNotNull()
        & F.col("area_m2").isNotNull()
        & (F.coalesce(F.col("floor"), F.lit("")) != "")
        & F.coalesce(F.col("address").rlike(tx.EXACT + r"\d"), F.lit(False))
    )
    return F.when(
        complete,
        F.struct(
            F.col("rooms").alias("rooms"),
            F.rint(F.col("area_m2") * 10).cast("bigint").alias("area10"),
            F.replace(F.col("floor"), F.lit(" "), F.lit("")).alias("floor"),
            address.alias("address"),
        ),
    )


def collapse_clones(previews: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per flat: the cheapest clone, at the place of the first one.

    Adds ``place`` (the order struct of the first clone). A known price beats an
    unknown one, an equal price keeps the earlier row. Rows without a
    fingerprint all stay. Uses a two-phase aggregate, so a flat posted very many
    times is pre-reduced in every task.
    """
    marked = previews.withColumn("__print", fingerprint())
    place = F.struct(*order)
    single = marked.where(F.col("__print").isNull()).withColumn("place", place).drop("__print")
    rest = [c for c in previews.columns if c not in scope]
    # what decides leads the row, so that nothing travels twice; maps have no order
    leading = ["price_kzt", *[c for c in order if c != "price_kzt"]]
    if any("map<" in kind for _, kind in previews.dtypes) or not set(leading) <= set(rest):
        cheapest = F.struct(F.col("price_kzt").isNull().alias("no_price"), F.col("price_kzt"), place)
        row = F.min_by(F.struct(*rest), cheapest)
    else:
        no_price = F.col("price_kzt").isNull().alias("__no_price")
        row = F.min(F.struct(no_price, *leading, *[c for c in rest if c not in leading]))
    merged = (
        marked.where(F.col("__print").isNotNull())
        .groupBy(*scope, "__print")
        .agg(row.alias("__row"), F.min(place).alias("place"))
        .select(*scope, "__row.*", "place")
    )
    return merged.select(*previews.columns, "place").unionByName(single)


def top_per_user(pairs: DataFrame, order: Sequence[Column | str], limit: int = MAX_RESULTS) -> DataFrame:
    """First ``limit`` candidates of every user; adds ``rank``."""
    w = Window.partitionBy("user_id").orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
