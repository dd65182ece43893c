"""Search criteria from free text and from extracted patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvartal.functions import text as tx
from kvartal.functions.once import compute_once

DEFAULT_DEAL = "sale"
DEFAULT_PAGES = 3
MAX_PAGES = 20
#: A list of rooms must fit in one row; what is wider can't be one.
WIDEST_ROOM_RANGE = 1_000_000

# Markers and word lists of the request language.
RENT_MARKERS = ("аренд", "снят", "сним", "rent")
SALE_MARKERS = ("куп", "покуп", "sale", "buy")
DAILY_MARKERS = ("посуточ", "на сутки")
HOURLY_MARKERS = ("по часам", "почасов")
MONTHLY_MARKERS = ("помесяч", "на месяц", "долгосрочн")
OWNER_MARKERS = (
    "от хозяина", "от хозяев", "от собственника", "от собственников",
    "без риелтор", "без риэлтор", "без посредник", "без агент",
)
NUMBER = r"(\d+(?:[.,]\d+)?)"
MONEY_UNIT = r"(?:млн|миллион\w*|m)|(?:тыс\w*|k)|(?:тг|тенге|₸)"
AREA_WORDS = ("м2", "м²", "m2")
AREA_UNIT = rf"(?:{'|'.join(AREA_WORDS)})"
ROOM_WORDS = {
    "одно": 1, "двух": 2, "трех": 3, "трёх": 3, "четырех": 4, "четырёх": 4, "пяти": 5, "шести": 6,
}
ROOM_SLANG = {
    "однушк": 1, "двушк": 2, "трешк": 3, "трёшк": 3, "четырешк": 4, "четырёшк": 4,
}
HELP_MARKERS = ("помощ", "help", "что умеешь", "команды", "что дальше")
SAVED_MARKERS = ("сохран", "избран", "list", "список квартир")
CRITERIA_MARKERS = ("критер", "criteria", "параметр")
MONITOR_MARKERS = ("монитор", "monitor", "интервал")
REFINE_MARKERS = ("уточ", "измен", "добав", "убер", "остав", "только", "поменя", "обнов")
SEARCH_MARKERS = (
    "ищу", "нужн", "найд", "подбер", "покажи", "квартир", "квартира", "аренд", "сним", "куп", "продаж",
)
FIELD_MARKERS = (
    "до ", "от ", "район", "комнат", "площад", "pages", "страниц", "алмат", "астан", "шымкент",
)
PATCH_SALE = ("sale", "buy", "покупка", "купить", "продажа")
PATCH_RENT = ("rent", "аренда", "снять")
RENT_PERIODS = ("monthly", "daily", "hourly")
TRUE_WORDS = ("true", "1", "yes", "on", "t", "y", "1.0")
FALSE_WORDS = ("false", "0", "no", "off", "f", "n", "0.0")


def deal_type(text: Column) -> Column:
    return F.when(tx.contains_any(text, RENT_MARKERS), F.lit("rent")).when(
        tx.contains_any(text, SALE_MARKERS), F.lit("sale")
    )


def rent_period(text: Column) -> Column:
    return (
        F.when(tx.contains_any(text, DAILY_MARKERS), F.lit("daily"))
        .when(tx.contains_any(text, HOURLY_MARKERS), F.lit("hourly"))
        .when(tx.contains_any(text, MONTHLY_MARKERS), F.lit("monthly"))
    )


def owner_only(text: Column) -> Column:
    """True or null: a message never asks for agents."""
    return F.when(tx.contains_any(text, OWNER_MARKERS), F.lit(True))


def _tenge(amount: Column, unit: Column) -> Column:
    u = F.lower(unit)
    factor = (
        F.when(tx.contains_any(u, ("млн", "миллион")) | (u == "m"), F.lit(1_000_000.0))
        .when(F.contains(u, F.lit("тыс")) | (u == "k"), F.lit(1_000.0))
        .otherwise(F.lit(1.0))
    )
    return (tx.decimal_text(amount) * factor).try_cast("bigint")


def _ordered(low: Column, high: Column) -> Column:
    swap = F.coalesce(low > high, F.lit(False))
    return F.struct(
        F.when(swap, high).otherwise(low).alias("low"), F.when(swap, low).otherwise(high).alias("high")
    )


UNIT = f"({MONEY_UNIT})"
PRICE_RANGE = rf"(?:от\s+)?{NUMBER}\s*{UNIT}?\s*(?:-|–|до|to)\s*{NUMBER}\s*{UNIT}"
PRICE_MIN = rf"(?:от|min|from)\s+{NUMBER}\s*{UNIT}"
PRICE_MAX = rf"(?:до|max|не\s+дороже)\s+{NUMBER}\s*{UNIT}"
PRICE_VALUE = rf"{NUMBER}\s*{UNIT}"
AREA_RANGE = rf"{NUMBER}\s*(?:-|–|до|to)\s*{NUMBER}\s*{AREA_UNIT}"
AREA_MIN = rf"(?:от|min|from)\s+{NUMBER}\s*{AREA_UNIT}"
AREA_MAX = rf"(?:до|max)\s+{NUMBER}\s*{AREA_UNIT}"


def with_price_bounds(rows: DataFrame, text: str) -> DataFrame:
    """min_price_kzt and max_price_kzt named in a text.

    A range, else min and max words, else a single value as the maximum. The
    first bound of a range may lack a unit and takes that of the second. Each
    step is a column of its own, so a pattern runs once per text; the patterns of
    bounds only run on texts that hold a number with a unit.
    """
    no_values = F.array().cast("array<string>")
    digit = F.col(text).rlike(r"(?U)\d")
    rows = compute_once(
        rows, {"__values": F.when(digit, tx.all_matches(text, PRICE_VALUE, 0)).otherwise(F.when(F.col(text).isNotNull(), no_values))}
    )
    some = F.size("__values") > 0
    rows = compute_once(
        rows,
        {
            "__range": F.when(some, tx.first_match(text, PRICE_RANGE, 0)),
            "__min": F.when(some, tx.first_match(text, PRICE_MIN, 0)),
            "__max": F.when(some, tx.first_match(text, PRICE_MAX, 0)),
        },
    )

    def part(column: str, pattern: str, group: int) -> Column:
        return tx.first_match(column, pattern, group)

    def amount(matched: Column, pattern: str) -> Column:
        return _tenge(tx.first_match(matched, pattern, 1), tx.first_match(matched, pattern, 2))

    last_unit = part("__range", PRICE_RANGE, 4)
    rows = compute_once(
        rows,
        {
            "__low": _tenge(
                part("__range", PRICE_RANGE, 1), F.coalesce(part("__range", PRICE_RANGE, 2), last_unit)
            ),
            "__high": _tenge(part("__range", PRICE_RANGE, 3), last_unit),
            "__floor": amount(F.col("__min"), PRICE_MIN),
            "__cap": F.coalesce(
                amount(F.col("__max"), PRICE_MAX),
                F.when(
                    F.col("__min").isNull() & F.col("__max").isNull() & (F.size("__values") == 1),
                    amount(F.get("__values", F.lit(0)), PRICE_VALUE),
                ),
            ),
        },
    )
    return _settle(rows, "min_price_kzt", "max_price_kzt")


def with_area_bounds(rows: DataFrame, text: str) -> DataFrame:
    """min_area_m2 and max_area_m2; the patterns only run on texts that name a unit of area."""
    named = tx.contains_any(F.lower(F.col(text)), AREA_WORDS)

    def number(pattern: str, group: int) -> Column:
        return F.when(named, tx.decimal_text(tx.first_match(text, pattern, group)))

    rows = compute_once(
        rows,
        {
            "__low": number(AREA_RANGE, 1),
            "__high": number(AREA_RANGE, 2),
            "__floor": number(AREA_MIN, 1),
            "__cap": number(AREA_MAX, 1),
        },
    )
    return _settle(rows, "min_area_m2", "max_area_m2")


def _settle(rows: DataFrame, low: str, high: str) -> DataFrame:
    """A proper range wins; else the two bounds, swapped when the wrong way round."""
    ranged = F.coalesce(F.col("__low") <= F.col("__high"), F.lit(False))
    swap = F.coalesce(F.col("__floor") > F.col("__cap"), F.lit(False))
    first, second = F.col("__floor"), F.col("__cap")
    helpers = [c for c in ("__range", "__min", "__max", "__values", "__low", "__high", "__floor", "__cap") if c in rows.columns]
    return rows.withColumns(
        {
            low: F.when(ranged, F.col("__low")).when(swap, second).otherwise(first),
            high: F.when(ranged, F.col("__high")).when(swap, first).otherwise(second),
        }
    ).drop(*helpers)


def _numbers(items: Column) -> Column:
    return F.transform(items, lambda x: x.try_cast("int"))


def _word_numbers(text: Column, words: dict[str, int], tail: str) -> Column:
    pattern = f"({'|'.join(words)}){tail}"
    table = F.create_map(*[F.lit(v) for pair in words.items() for v in pair])
    return F.transform(tx.all_matches(text, pattern), lambda w: F.try_element_at(table, F.lower(w)))


def _positive_set(numbers: Column) -> Column:
    rooms = F.array_sort(F.array_distinct(F.filter(F.array_compact(numbers), lambda n: n > 0)))
    return F.when(F.size(rooms) > 0, rooms)


def rooms(text: Column) -> Column:
    """Sorted room counts named in the text, null when none.

    A range stands for all of its counts.
    """
    unit = r"(?:ком\w*|room\w*)"
    ranged = rf"(\d+)\s*(?:-|–)\s*(\d+)\s*{unit}"
    start = tx.first_match(text, ranged, 1).try_cast("int")
    end = tx.first_match(text, ranged, 2).try_cast("int")
    none = F.array().cast("array<int>")
    usable = (start <= end) & (end - start <= WIDEST_ROOM_RANGE)
    span = F.when(usable, F.sequence(start, F.when(usable, end).otherwise(start))).otherwise(none)
    either = r"(\d+)\s*(?:или|or)\s*(\d+)"
    found = F.concat(
        span,
        _numbers(tx.all_matches(text, either, 1)),
        _numbers(tx.all_matches(text, either, 2)),
        _numbers(tx.all_matches(text, rf"(\d+)[-–\s]*{unit}", 1)),
        _word_numbers(text, ROOM_WORDS, r"[-\s]*ком\w*"),
        _word_numbers(text, ROOM_SLANG, r"\w*"),
    )
    return _positive_set(found)


def page_limit(text: Column) -> Column:
    n = tx.first_match(text, r"(?:pages?|page_limit|страниц\w*)\s*(\d+)", 1).try_cast("double")
    clamped = F.least(F.greatest(n, F.lit(1.0)), F.lit(float(MAX_PAGES)))
    return F.when(n.isNotNull(), clamped.cast("int"))


def request_text(message: Column | str) -> Column:
    return F.lower(tx.strip(message))


FOUND = (
    "deal_type", "rent_period", "min_price_kzt", "max_price_kzt", "min_area_m2", "max_area_m2",
    "rooms", "page_limit", "owner_only",
)


def parse_text(messages: DataFrame, message: str = "message") -> DataFrame:
    """What each message names; a field it does not name is null."""
    rows = compute_once(messages, {"__t": request_text(message)})
    rows = with_area_bounds(with_price_bounds(rows, "__t"), "__t")
    t = F.col("__t")
    return compute_once(
        rows,
        {
            "deal_type": deal_type(t),
            "rent_period": rent_period(t),
            "rooms": rooms(t),
            "page_limit": page_limit(t),
            "owner_only": owner_only(t),
        },
    ).drop("__t")


# --- patches of an external extractor -----------------------------------------


def _kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def parse_patches(patches: DataFrame, column: str = "patch") -> DataFrame:
    """Typed criteria patches of JSON texts.

    A patch with one field of the wrong type or out of bounds is dropped as a
    whole (``patch_ok`` false, all fields null), and so is one without values.
    Bounds given the wrong way round are swapped.
    """
    rows = compute_once(patches, {"__v": F.try_parse_json(column)})
    v = F.col("__v")
    names = ("city", "deal_type", "rent_period", "min_price_kzt", "max_price_kzt", "rooms", "districts",
             "min_area_m2", "max_area_m2", "owner_only", "page_limit")
    rows = compute_once(
        rows,
        {f"__k_{n}": F.coalesce(_kind(v, n), F.lit("VOID")) for n in names}
        | {f"__r_{n}": F.try_variant_get(v, f"$.{n}", "string") for n in names},
    )

    def raw(field: str) -> Column:
        return F.col(f"__r_{field}")

    def kind(field: str) -> Column:
        return F.col(f"__k_{field}")

    def absent(field: str) -> Column:
        return kind(field) == "VOID"

    def is_text(field: str) -> Column:
        return kind(field) == "STRING"

    def is_number(field: str) -> Column:
        return (kind(field) == "BIGINT") | (kind(field) == "DOUBLE") | F.startswith(kind(field), F.lit("DECIMAL"))

    def number(field: str) -> Column:
        return F.trim(raw(field)).try_cast("double")

    def whole(field: str) -> Column:
        shape = F.trim(raw(field)).rlike(r"^[+-]?\d+(\.0*)?$")
        return F.when((is_number(field) | is_text(field)) & shape, number(field).cast("bigint"))

    def real(field: str) -> Column:
        return F.when(is_number(field) | is_text(field), number(field))

    city = tx.blank_to_null(tx.strip(raw("city")))
    deal = F.lower(tx.strip(raw("deal_type")))
    deal = F.when(deal.isin(*PATCH_SALE), F.lit("sale")).when(deal.isin(*PATCH_RENT), F.lit("rent"))
    period = F.when(raw("rent_period").isin(*RENT_PERIODS), raw("rent_period"))
    owner_text = F.lower(raw("owner_only"))
    owner = F.when(owner_text.isin(*TRUE_WORDS), True).when(owner_text.isin(*FALSE_WORDS), False)
    # a page count may be a decimal; it is cut to a whole number first
    pages = F.when(is_number("page_limit") | is_text("page_limit"), number("page_limit").cast("int"))
    low_price, high_price = whole("min_price_kzt"), whole("max_price_kzt")
    low_area, high_area = real("min_area_m2"), real("max_area_m2")

    def bad(field: str, value: Column, fits: Column | None = None) -> Column:
        wrong = value.isNull() if fits is None else value.isNull() | ~fits
        return ~absent(field) & wrong

    invalid = (
        (~absent("city") & ~is_text("city"))
        | bad("deal_type", deal)
        | bad("rent_period", period)
        | bad("min_price_kzt", low_price, low_price >= 0)
        | bad("max_price_kzt", high_price, high_price >= 0)
        | bad("min_area_m2", low_area, low_area >= 0)
        | bad("max_area_m2", high_area, high_area >= 0)
        | bad("owner_only", owner)
        | bad("page_limit", pages, pages.between(1, MAX_PAGES))
        | ~F.startswith(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), F.lit("OBJECT"))
    )

    rooms_text = F.lower(tx.strip(raw("rooms")))
    span = r"^(\d+)\s*(?:-|–|to)\s*(\d+)$"
    start = tx.first_match(rooms_text, span, 1).try_cast("int")
    end = tx.first_match(rooms_text, span, 2).try_cast("int")
    none = F.array().cast("array<int>")
    usable = (start <= end) & (end - start <= WIDEST_ROOM_RANGE)
    from_text = F.when(
        start.isNotNull() & end.isNotNull(),
        F.when(usable, F.sequence(start, F.when(usable, end).otherwise(start))).otherwise(none),
    ).otherwise(_numbers(tx.all_matches(rooms_text, r"(\d+)")))
    room_items = F.try_variant_get(v, "$.rooms", "array<variant>")

    def room_item(item: Column) -> Column:
        text = F.try_variant_get(item, "$", "string")
        is_string = F.schema_of_variant(item) == "STRING"
        value = F.array(text.try_cast("double").cast("int"))
        return F.when(is_string, _numbers(tx.all_matches(text, r"(\d+)"))).otherwise(value)

    listed = F.flatten(F.transform(room_items, room_item))
    room_set = _positive_set(
        F.when(F.startswith(kind("rooms"), F.lit("ARRAY")), listed)
        .when(is_text("rooms"), from_text)
        .when(is_number("rooms"), F.array(number("rooms").cast("int")))
        .otherwise(none)
    )
    labels = F.when(
        F.startswith(kind("districts"), F.lit("ARRAY")), F.try_variant_get(v, "$.districts", "array<string>")
    ).when(is_text("districts"), F.array(raw("districts")))
    labels = F.filter(F.transform(labels, tx.strip), lambda d: d != "")
    labels = F.when(F.size(labels) > 0, labels)
    price = _ordered(low_price, high_price)
    area = _ordered(low_area, high_area)
    fields = {
        "city": city,
        "deal_type": deal,
        "rent_period": period,
        "min_price_kzt": price["low"],
        "max_price_kzt": price["high"],
        "rooms": room_set,
        "districts": labels,
        "min_area_m2": area["low"],
        "max_area_m2": area["high"],
        "owner_only": owner,
        "page_limit": pages,
    }
    rows = compute_once(
        rows,
        {f"patch_{name}": value for name, value in fields.items()}
        | {"__valid": v.isNotNull() & ~F.coalesce(invalid, F.lit(True))},
    )
    some = F.lit(False)
    for name in fields:
        some = some | F.col(f"patch_{name}").isNotNull()
    rows = compute_once(rows, {"patch_ok": F.col("__valid") & some})
    return rows.select(
        *patches.columns,
        "patch_ok",
        *[F.when(F.col("patch_ok"), F.col(f"patch_{name}")).alias(f"patch_{name}") for name in fields],
    )


def combine(messages: DataFrame) -> DataFrame:
    """One set of found fields per message: a valid patch, else the text.

    Messages carry the patch_* columns. With a patch only owner and rent term are
    back-filled from the text. ``from_patch`` tells which path was taken.
    """
    texts = parse_text(messages)
    patched = F.coalesce("patch_ok", F.lit(False))
    fields = {}
    for name in FOUND:
        from_patch, from_text = F.col(f"patch_{name}"), F.col(name)
        if name in ("owner_only", "rent_period"):
            from_patch = F.coalesce(from_patch, from_text)
        fields[name] = F.when(patched, from_patch).otherwise(from_text)
    return compute_once(texts, {**fields, "from_patch": patched})


def new_criteria(found: DataFrame) -> DataFrame:
    """Criteria of a new search from found fields and a resolved location.

    A rent term implies rent: always for text, for a patch only without a deal
    of its own. A sale has no rent term.
    """
    implied = F.col("rent_period").isNotNull() & (~F.col("from_patch") | F.col("deal_type").isNull())
    deal = F.when(implied, F.lit("rent")).otherwise(F.coalesce("deal_type", F.lit(DEFAULT_DEAL)))
    return compute_once(
        found,
        {
            "deal_type": deal,
            "rent_period": F.when(deal == "rent", F.col("rent_period")),
            "owner_only": F.coalesce("owner_only", F.lit(False)),
            "page_limit": F.coalesce("page_limit", F.lit(DEFAULT_PAGES)),
            "property_type": F.lit("apartment"),
        },
    )


def has_signal() -> Column:
    """The message names a concrete criterion or a city."""
    return (
        F.col("rooms").isNotNull()
        | F.col("min_price_kzt").isNotNull()
        | F.col("max_price_kzt").isNotNull()
        | F.col("min_area_m2").isNotNull()
        | F.col("max_area_m2").isNotNull()
        | (F.coalesce(F.size("districts"), F.lit(0)) > 0)
        | ~F.coalesce("defaulted_city", F.lit(True))
    )


def dialog_class(message: Column | str, has_criteria: Column) -> Column:
    """What a chat message asks for, first rule wins."""
    t = request_text(message)
    search = tx.contains_any(t, SEARCH_MARKERS)
    field = tx.contains_any(t, FIELD_MARKERS)
    refine = tx.contains_any(t, REFINE_MARKERS) | (~search & field)
    return (
        F.when(tx.contains_any(t, HELP_MARKERS), F.lit("help"))
        .when(tx.contains_any(t, MONITOR_MARKERS), F.lit("show_monitor"))
        .when(tx.contains_any(t, SAVED_MARKERS), F.lit("show_saved"))
        .when(tx.contains_any(t, CRITERIA_MARKERS), F.lit("show_criteria"))
        .when(has_criteria & refine, F.lit("refine"))
        .when(search | field, F.lit("search"))
        .when(has_criteria, F.lit("refine"))
        .otherwise(F.lit("help"))
    )
