"""Crawled pages to previews, listings and rejects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions import html as h
from kvartal.functions import listing_text as lt
from kvartal.functions import text as tx

POSTERS = ("owner", "agent", "developer")
PREVIEW = (
    "external_id", "url", "title", "price_kzt", "rooms", "area_m2", "floor", "district", "address",
)


def open_pages(pages: DataFrame) -> DataFrame:
    """Pages that are not anti-bot interstitials."""
    return pages.where(~lt.is_blocked("html", "status"))


def previews(pages: DataFrame, base_url: str, keep: tuple[str, ...] = ("url", "page_no")) -> DataFrame:
    """One row per listing of a page, in page order (``card_pos``).

    The first card of an id on a page counts. Specs are read from the title
    first, then from subtitle and details. ``keep`` columns of the page stay,
    prefixed with ``page_`` where they would clash.
    """
    kept = {c: (c if c.startswith("page_") else f"page_{c}") for c in keep}
    cards = h.card_texts("html")
    marked = pages.select(*[F.col(c).alias(n) for c, n in kept.items()], cards.alias("__cards"))
    marked = marked.withColumn(
        "__cards",
        F.filter(
            F.transform("__cards", lambda c: F.struct(lt.listing_id(c["href"]).alias("id"), c.alias("c"))),
            lambda c: c["id"].isNotNull(),
        ),
    ).withColumn("__cards", tx.first_by(F.col("__cards"), "id"))
    # outer: for a plain explode Spark infers a test on the array, for which it reads every page twice
    rows = marked.select(*kept.values(), F.posexplode_outer("__cards").alias("card_pos", "__card"))
    rows = rows.where(F.col("__card").isNotNull()).select(*kept.values(), "card_pos", F.col("__card.id").alias("external_id"), "__card.c.*")
    params = tx.blank_to_null(F.concat_ws(" ", "subtitle", "details"))
    title = F.coalesce("title", F.concat(F.lit("Apartment "), F.col("external_id")))
    rows = rows.withColumns(
        {"title": title, "__params": params, "__spec": F.concat_ws(" ", title, params)}
    )
    return rows.select(
        *kept.values(),
        "card_pos",
        "external_id",
        lt.absolute_url("href", base_url).alias("url"),
        "title",
        lt.price("price_text").alias("price_kzt"),
        lt.rooms("__spec").alias("rooms"),
        lt.area("__spec").alias("area_m2"),
        lt.floor("__spec").alias("floor"),
        F.coalesce(lt.district_label("subtitle"), lt.district_label("__params")).alias("district"),
        F.col("subtitle").alias("address"),
    )


def _truthy(json: str, field: str) -> Column:
    value = F.get_json_object(json, f"$.{field}")
    return value.isNotNull() & ~value.isin("false", "null", "0", "")


def detail_fields(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fields of detail pages (external_id, html), one row per page; ``keep`` columns of the page stay."""
    rows = pages.select(*keep, "external_id", "html", h.detail_texts("html").alias("d"), h.detail_json("html").alias("j"))
    rows = rows.withColumn("params", tx.first_by(F.col("d.params"), "label"))
    posted = F.when(F.col("j.owner_json").isNotNull(), F.when(_truthy("j.owner_json", "isOwner"), F.lit("owner"))
                    .when(_truthy("j.owner_json", "isBuilder") | _truthy("j.owner_json", "isComplex"), F.lit("developer"))
                    .otherwise(F.lit("agent")))
    rows = rows.withColumn("posted_by", posted)
    agency = tx.blank_to_null(tx.strip(F.get_json_object("j.agency_json", "$.name")))
    return rows.select(
        *keep,
        "external_id",
        F.col("d.title").alias("detail_title"),
        lt.price("d.price_text").alias("detail_price"),
        F.coalesce(F.col("d.address"), lt.title_address("d.page_title")).alias("detail_address"),
        lt.rooms("d.detail_text").alias("detail_rooms"),
        lt.area("d.detail_text").alias("detail_area"),
        lt.floor("d.detail_text").alias("detail_floor"),
        "posted_by",
        F.when(F.col("posted_by") == "agent", agency).alias("agency_name"),
        lt.description("d.description").alias("description"),
        lt.market_diff("html").alias("market_diff_percent"),
        lt.param_year("params", "год постройки").alias("build_year"),
        lt.param("params", "тип дома").alias("building_type"),
        lt.param_number("params", "высота потолков").alias("ceiling_height_m"),
        lt.param("params", "меблирова").alias("furnished"),
        lt.param("params", "состояние").alias("condition"),
        lt.photos("html").alias("photos"),
        lt.published_at("html", "d.time_attr", "d.test_attr", "d.full_text").alias("published_at"),
    )


def details_of(previews_: DataFrame, pages: DataFrame) -> DataFrame:
    """Detail fields of the previews' pages only: other pages are not parsed."""
    wanted = previews_.select("external_id").distinct()
    return detail_fields(pages.join(wanted, "external_id", "left_semi"))


def merge_detail(previews_: DataFrame, details: DataFrame, source: str, scraped_at: Column) -> DataFrame:
    """Listings of previews and their detail pages.

    The preview decides rooms, area and floor, the detail page price, title,
    district and address; each falls back on the other.
    """
    carried = [c for c in previews_.columns if c not in PREVIEW and c != "city"]
    return as_listings(previews_.join(details, "external_id", "inner"), carried, source, scraped_at)


def as_listings(rows: DataFrame, carried: Sequence[str], source: str, scraped_at: Column) -> DataFrame:
    """Listings of rows that hold a preview and the fields of its detail page (null where it is missing)."""
    address = F.coalesce("detail_address", "address")
    return rows.select(
        *carried,
        "external_id",
        F.lit(source).alias("source"),
        "url",
        F.coalesce("detail_title", "title").alias("title"),
        F.coalesce("detail_price", "price_kzt").alias("price_kzt"),
        tx.strip("city").alias("city"),
        F.coalesce(lt.district_label(address), F.col("district")).alias("district"),
        address.alias("address"),
        F.coalesce("area_m2", "detail_area").alias("area_m2"),
        F.coalesce("floor", "detail_floor").alias("floor"),
        F.coalesce("rooms", "detail_rooms").alias("rooms"),
        "posted_by",
        "agency_name",
        "description",
        "market_diff_percent",
        "build_year",
        "building_type",
        "ceiling_height_m",
        "furnished",
        "condition",
        "photos",
        "published_at",
        scraped_at.alias("scraped_at"),
    )


def _absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#]+"), F.lit(False))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def listing_problems() -> Column:
    """Names of the listing fields that break a rule."""
    rules = {
        "external_id": _blank("external_id"),
        "url": ~_absolute(F.col("url")),
        "title": _blank("title"),
        "price_kzt": ~F.coalesce(F.col("price_kzt") > 0, F.lit(False)),
        "city": _blank("city"),
        "area_m2": F.col("area_m2") <= 0,
        "rooms": F.col("rooms") <= 0,
        "posted_by": ~F.col("posted_by").isin(*POSTERS),
        "build_year": ~F.col("build_year").between(1900, 2100),
        "ceiling_height_m": F.col("ceiling_height_m") <= 0,
        "photos": F.exists(F.col("photos"), lambda p: ~_absolute(p)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def criteria_problems() -> Column:
    """Names of the criteria rules that are broken; bounds are not swapped here."""
    rules = {
        "user_id": ~F.coalesce(F.col("user_id") > 0, F.lit(False)),
        "city": F.coalesce(tx.strip("city"), F.lit("")) == "",
        "deal_type": ~F.coalesce(F.col("deal_type").isin("sale", "rent"), F.lit(False)),
        "rent_period": ~F.col("rent_period").isin("monthly", "daily", "hourly"),
        "min_price_kzt": F.col("min_price_kzt") < 0,
        "max_price_kzt": F.col("max_price_kzt") < 0,
        "price_range": F.col("min_price_kzt") > F.col("max_price_kzt"),
        "rooms": (F.size("rooms") == 0) | F.exists("rooms", lambda r: r <= 0),
        "districts": F.size(F.filter("districts", lambda d: tx.strip(d) != "")) == 0,
        "min_area_m2": F.col("min_area_m2") < 0,
        "max_area_m2": F.col("max_area_m2") < 0,
        "area_range": F.col("min_area_m2") > F.col("max_area_m2"),
        "page_limit": ~F.coalesce(F.col("page_limit").between(1, 20), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def split_valid(rows: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with ``problems``)."""
    judged = rows.withColumn("problems", problems)
    good = judged.where(F.size("problems") == 0).drop("problems")
    return good, judged.where(F.size("problems") > 0)
