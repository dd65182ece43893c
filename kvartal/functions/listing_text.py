"""Listing attributes read from card and detail texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvartal.functions import text as tx

# Text shapes of the crawled site.
LISTING_ID = r"/a/show/(\d+)"
PRICE = r"(\d[\d\s]{2,}\d)"
AREA = r"(\d+(?:[.,]\d+)?)\s*(?:кв\.?\s*м|м\s*²|м\s*2|m\s*²|m\s*2)"
FLOOR = r"(\d+\s*/\s*\d+)"
ROOMS_SHORT = r"(\d+)\s*[- ]?ком"
ROOMS_LABEL = r"комнат\w*\s*[:\-]?\s*(\d+)"
DATE_DOTTED = r"(\d{2}\.\d{2}\.\d{4})"
CREATED_AT = r'"createdAt"\s*:\s*"(\d{4}-\d{2}-\d{2})'
ADDED_AT = r'"addedAt"\s*:\s*"(\d{4}-\d{2}-\d{2})'
TITLE_ADDRESS = r"№\d+:\s*(.+?)\s*[—–-]\s*за\s"
MARKET_DIFF = r"На\s+([\d]+(?:[.,]\d+)?)\s*%\s*(дешевле|дороже)"
PHOTO = (
    r"(https://[\w.-]*kcdn\.[a-z]+/webp/[^\s\"'<>\\]+?"
    r"-(?:\d+x\d+|full)\.(?:jpg|jpeg|png))"
)
PHOTO_SIZE = r"-(?:\d+x\d+|full)\.(?:jpg|jpeg|png)$"
PHOTO_SUFFIX = "-750x470.jpg"
MAX_FLOOR = 60
DESCRIPTION_CHARS = 2000
BLOCK_MARKERS = ("captcha", "verify you are human", "too many requests", "access denied")
LISTING_MARKERS = ("/a/show/", "a-card", "offer__price", "offer__title")


def is_blocked(html: Column | str, status: Column | str | None = None) -> Column:
    """An anti-bot page: a marker and no listing content, or HTTP 429."""
    # the text is bound: a filter works out anew what stands in it several times
    blocked = F.exists(
        F.array(F.lower(tx.col(html))),
        lambda page: tx.contains_any(page, BLOCK_MARKERS) & ~tx.contains_any(page, LISTING_MARKERS),
    )
    if status is None:
        return blocked
    return blocked | F.coalesce(tx.col(status) == 429, F.lit(False))


def listing_id(href: Column | str) -> Column:
    return tx.first_match(href, LISTING_ID, flags=tx.EXACT)


def bare_url(url: Column | str) -> Column:
    """Url without query and fragment."""
    return F.regexp_replace(tx.col(url), r"(?s)[?#].*$", "")


def absolute_url(href: Column | str, base_url: str) -> Column:
    """Resolve an href against the site root and drop query and fragment."""
    h = bare_url(href)
    root = base_url.rstrip("/")
    scheme = root.split("://", 1)[0]
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(F.lit(scheme + ":"), h))
        .when(F.startswith(h, F.lit("/")), F.concat(F.lit(root), h))
        .otherwise(F.concat(F.lit(root + "/"), h))
    )


def display_url(url: Column | str) -> Column:
    """Canonical host for showing: the mobile host prefix is dropped."""
    return F.replace(bare_url(url), F.lit("//m."), F.lit("//"))


def price(text: Column | str) -> Column:
    found = tx.first_match(tx.plain_spaces(text), PRICE, flags=tx.EXACT)
    return tx.digits_to_long(found)


def rooms(text: Column | str) -> Column:
    t = tx.plain_spaces(text)
    return F.coalesce(
        tx.first_match(t, ROOMS_SHORT, flags=tx.EXACT).try_cast("int"),
        tx.first_match(t, ROOMS_LABEL).try_cast("int"),
    )


def area(text: Column | str) -> Column:
    return tx.decimal_text(tx.first_match(tx.plain_spaces(text), AREA))


def floor(text: Column | str) -> Column:
    """First ``n/m`` that can be a storey; a house number such as 535/2 cannot."""
    pairs = F.transform(
        tx.all_matches(text, FLOOR, flags=tx.EXACT),
        lambda x: F.transform(
            F.split(F.regexp_replace(x, tx.EXACT + r"\s", ""), "/"),
            lambda n: n.try_cast("int"),
        ),
    )
    good = F.filter(
        pairs,
        lambda p: (F.get(p, 0) >= 1) & (F.get(p, 0) <= F.get(p, 1)) & (F.get(p, 1) <= MAX_FLOOR),
    )
    best = F.get(good, 0)
    return F.when(
        best.isNotNull(),
        F.concat_ws("/", F.get(best, 0).cast("string"), F.get(best, 1).cast("string")),
    )


def district_label(text: Column | str) -> Column:
    """First comma or bar separated part that names a district."""
    parts = F.transform(F.split(tx.plain_spaces(text), r"[,|]"), tx.strip)
    named = F.filter(
        parts, lambda p: F.contains(F.lower(p), F.lit("р-н")) | F.contains(F.lower(p), F.lit("район"))
    )
    return F.get(named, 0)


def title_address(page_title: Column | str) -> Column:
    return tx.blank_to_null(tx.strip(tx.first_match(page_title, TITLE_ADDRESS)))


def photos(html: Column | str) -> Column:
    """Distinct photos in page order, all in one display size."""
    bases = F.transform(
        tx.all_matches(html, PHOTO), lambda u: F.regexp_replace(u, "(?i)" + PHOTO_SIZE, "")
    )
    return F.transform(F.array_distinct(bases), lambda b: F.concat(b, F.lit(PHOTO_SUFFIX)))


def published_at(
    html: Column | str, time_attr: Column | str, test_attr: Column | str, text: Column | str
) -> Column:
    """Original post date, else last bump, else mark-up, else a dotted date.

    What names no zone is UTC, whatever the session's time zone.
    """
    return F.coalesce(
        _utc_day(tx.first_match(html, CREATED_AT, flags=tx.EXACT), "yyyy-MM-dd"),
        _utc_day(tx.first_match(html, ADDED_AT, flags=tx.EXACT), "yyyy-MM-dd"),
        _utc_time(tx.col(time_attr)),
        _utc_time(tx.col(test_attr)),
        _utc_day(tx.first_match(text, DATE_DOTTED, flags=tx.EXACT), "dd.MM.yyyy"),
    )


def _utc_day(day: Column, pattern: str) -> Column:
    return F.try_to_timestamp(F.concat(day, F.lit(" +00:00")), F.lit(pattern + " XXX"))


def _utc_time(value: Column) -> Column:
    full = F.when(value.rlike(r"\d{2}:\d{2}"), value).otherwise(F.concat(value, F.lit("T00:00:00")))
    zoned = full.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(zoned, full).otherwise(F.concat(full, F.lit("Z"))))


def market_diff(html: Column | str) -> Column:
    """Signed percent against the city market; cheaper is negative."""
    value = tx.decimal_text(tx.first_match(html, MARKET_DIFF, 1))
    word = F.lower(tx.first_match(html, MARKET_DIFF, 2))
    return F.when(word == "дешевле", -value).otherwise(value)


def description(text: Column | str) -> Column:
    body = tx.strip(F.regexp_replace(tx.col(text), r"\n{3,}", "\n\n"))
    return tx.blank_to_null(F.substring(body, 1, DESCRIPTION_CHARS))


def param(entries: Column | str, needle: str) -> Column:
    """Value of the first parameter whose label holds ``needle``."""
    hit = F.get(F.filter(tx.col(entries), lambda e: F.contains(e["label"], F.lit(needle))), 0)
    return hit["value"]


def param_year(entries: Column | str, needle: str) -> Column:
    return tx.first_match(param(entries, needle), r"(\d{4})", flags=tx.EXACT).try_cast("int")


def param_number(entries: Column | str, needle: str) -> Column:
    return tx.decimal_text(tx.first_match(param(entries, needle), r"(\d+(?:[.,]\d+)?)"))
