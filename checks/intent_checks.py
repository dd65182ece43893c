"""Texts to locations and criteria."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import sql
from kvartal.functions import location_text as lt
from kvartal.operators import intent as it
from kvartal.operators import locate as lo
from kvartal.sources import catalog as cat


def ints(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _parsed(v):
    return it.parse_text(v.messages)


def _field(*names):
    def build(v):
        cols = [ints("rooms").alias("rooms") if n == "rooms" else F.col(n) for n in names]
        return _parsed(v).select("msg_id", *cols)

    return build


T = "(SELECT msg_id, lower(trim(message)) AS t FROM v_messages)"
W = r"[\p{L}\p{N}_]"
NUM = r"(\d+(?:[.,]\d+)?)"
MU = rf"((?:млн|миллион{W}*|m)|(?:тыс{W}*|k)|(?:тг|тенге|₸))"


def _ex(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(t, '{pattern}', {group}), '')"


def _money(amount: str, unit: str) -> str:
    return (
        f"CAST(trunc(CAST(replace({amount}, ',', '.') AS DOUBLE) * CASE WHEN {unit} LIKE '%млн%' OR {unit} LIKE '%миллион%' "
        f"OR {unit} = 'm' THEN 1000000 WHEN {unit} LIKE '%тыс%' OR {unit} = 'k' THEN 1000 ELSE 1 END) AS BIGINT)"
    )


RANGE = rf"(?:от\s+)?{NUM}\s*{MU}?\s*(?:-|–|до|to)\s*{NUM}\s*{MU}"
PMIN = rf"(?:от|min|from)\s+{NUM}\s*{MU}"
PMAX = rf"(?:до|max|не\s+дороже)\s+{NUM}\s*{MU}"
LONE = rf"{NUM}\s*{MU}"
PRICE_SQL = f"""SELECT msg_id,
  CASE WHEN lo <= hi THEN lo WHEN fl > cp THEN cp ELSE fl END AS min_price_kzt,
  CASE WHEN lo <= hi THEN hi WHEN fl > cp THEN fl ELSE cp END AS max_price_kzt
FROM (SELECT msg_id, lo, hi, fl, CASE WHEN cp IS NULL AND fl IS NULL AND len(v) = 1 THEN {_money('v[1]', 'u[1]')} ELSE cp END AS cp
  FROM (SELECT msg_id, {_money('a1', 'coalesce(u1, u2)')} AS lo, {_money('a2', 'u2')} AS hi, {_money('m1', 'mu')} AS fl,
    {_money('x1', 'xu')} AS cp, v, u
  FROM (SELECT msg_id, {_ex(RANGE, 1)} AS a1, {_ex(RANGE, 2)} AS u1, {_ex(RANGE, 3)} AS a2, {_ex(RANGE, 4)} AS u2,
    {_ex(PMIN, 1)} AS m1, {_ex(PMIN, 2)} AS mu, {_ex(PMAX, 1)} AS x1, {_ex(PMAX, 2)} AS xu,
    regexp_extract_all(t, '{LONE}', 1) AS v, regexp_extract_all(t, '{LONE}', 2) AS u FROM {T})))"""

AU = r"(?:м2|м²|m2)"


def _dbl(e: str) -> str:
    return f"CAST(replace({e}, ',', '.') AS DOUBLE)"


_ALO = rf"{NUM}\s*(?:-|–|до|to)\s*{NUM}\s*{AU}"
AREA_SQL = f"""SELECT msg_id, CASE WHEN lo <= hi THEN lo WHEN fl > cp THEN cp ELSE fl END AS min_area_m2,
  CASE WHEN lo <= hi THEN hi WHEN fl > cp THEN fl ELSE cp END AS max_area_m2
FROM (SELECT msg_id, {_dbl(_ex(_ALO, 1))} AS lo, {_dbl(_ex(_ALO, 2))} AS hi,
  {_dbl(_ex(rf'(?:от|min|from)\s+{NUM}\s*{AU}', 1))} AS fl, {_dbl(_ex(rf'(?:до|max)\s+{NUM}\s*{AU}', 1))} AS cp FROM {T})"""

_UNIT = rf"(?:ком{W}*|room{W}*)"
_RR = rf"(\d+)\s*(?:-|–)\s*(\d+)\s*{_UNIT}"
_MAP = (
    "CASE x WHEN 'одно' THEN 1 WHEN 'двух' THEN 2 WHEN 'трех' THEN 3 WHEN 'трёх' THEN 3 WHEN 'четырех' THEN 4 "
    "WHEN 'четырёх' THEN 4 WHEN 'пяти' THEN 5 WHEN 'шести' THEN 6 WHEN 'однушк' THEN 1 WHEN 'двушк' THEN 2 "
    "WHEN 'трешк' THEN 3 WHEN 'трёшк' THEN 3 WHEN 'четырешк' THEN 4 WHEN 'четырёшк' THEN 4 END"
)
ROOMS_SQL = f"""SELECT msg_id, CASE WHEN len(rs) > 0 THEN array_to_string(rs, ',') END AS rooms FROM (
  SELECT msg_id, list_sort(list_distinct(list_filter(list_concat(
    coalesce(generate_series(CAST({_ex(_RR, 1)} AS BIGINT), CAST({_ex(_RR, 2)} AS BIGINT)), []),
    list_transform(regexp_extract_all(t, '(\\d+)\\s*(?:или|or)\\s*(\\d+)', 1), lambda x: CAST(x AS BIGINT)),
    list_transform(regexp_extract_all(t, '(\\d+)\\s*(?:или|or)\\s*(\\d+)', 2), lambda x: CAST(x AS BIGINT)),
    list_transform(regexp_extract_all(t, '(\\d+)[-–\\s]*{_UNIT}', 1), lambda x: CAST(x AS BIGINT)),
    list_transform(regexp_extract_all(t, '(одно|двух|трёх|трех|четырёх|четырех|пяти|шести)[-\\s]*ком', 1), lambda x: {_MAP}),
    list_transform(regexp_extract_all(t, '(однушк|двушк|трёшк|трешк|четырёшк|четырешк)', 1), lambda x: {_MAP})),
    lambda n: n > 0))) AS rs FROM {T})"""


def _any(markers, column="t") -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in markers) + ")"


DEAL_SQL = f"CASE WHEN {_any(it.RENT_MARKERS)} THEN 'rent' WHEN {_any(it.SALE_MARKERS)} THEN 'sale' END"
PERIOD_SQL = (
    f"CASE WHEN {_any(it.DAILY_MARKERS)} THEN 'daily' WHEN {_any(it.HOURLY_MARKERS)} THEN 'hourly' "
    f"WHEN {_any(it.MONTHLY_MARKERS)} THEN 'monthly' END"
)


def p29(v):
    return v.messages.select("msg_id", lt.normal("message").alias("normal"))


def p30(v):
    rows = v.table("nation").select(
        "n_nationkey", F.explode(F.array(F.lit("Аистовский"), F.lit("Новский"), F.lit("Мирская"), F.lit("Речной"),
                                         F.concat(F.lit("Уник"), F.col("n_name"), F.lit("ское")))).alias("name")
    )
    variants = F.array_join(F.array_sort(lt.alias_variants(lt.normal("name"))), "|")
    return rows.select("n_nationkey", "name", variants.alias("variants"))


def _texts(v):
    return v.messages.select("msg_id", lt.normal("message").alias("normal"))


def l2(v):
    return lo.best_city(lo.city_hits(_texts(v), ["msg_id"], v.catalog), ["msg_id"])


def l3(v):
    """District of a text inside the sender's own city."""
    hits = lo.district_hits(_texts(v), ["msg_id"], v.catalog)
    best = lo.best_district(hits, ["msg_id"])
    home = v.messages.select(
        "msg_id", F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("city")
    )
    return best.join(home, ["msg_id", "city"]).select("msg_id", "city", "district")


def l4(v):
    found = lo.districts_found(lo.district_hits(_texts(v), ["msg_id"], v.catalog), ["msg_id"])
    return found.select("msg_id", "city", "district", "len")


def l4b(v):
    labels = v.table("lineitem").select(F.col("l_returnflag").alias("label")).distinct().unionByName(
        v.table("nation").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("label"))
    )
    return lo.cities_of_label(labels, v.catalog).groupBy("label").agg(F.count(F.lit(1)).alias("cities"))


def l6(v):
    """Misspelled city names: one letter of the name doubled, swapped or lost."""
    o = v.table("orders").select(
        "o_orderkey", F.substring(F.lit("абвгдежзийклмнопрстуфхцчшщэюя"), (F.col("o_custkey") % 25 + 1).cast("int"), F.lit(1)).alias("c")
    )
    k = F.col("o_orderkey") % 4
    token = (
        F.when(k == 0, F.concat(F.lit("Старый Гград"), F.col("c")))
        .when(k == 1, F.concat(F.lit("Стары Град"), F.col("c")))
        .when(k == 2, F.concat(F.lit("Нов-Ргад"), F.col("c")))
        .otherwise(F.concat(F.lit("Кл"), F.col("c")))
    )
    tokens = o.select("o_orderkey", token.alias("token"))
    guess = lo.fuzzy_city(tokens, v.catalog)
    return tokens.join(guess, "token", "left").groupBy("token", "city").agg(F.count(F.lit(1)).alias("n"))


def l7(v):
    return cat.flat_district_aliases(v.catalog)


def l8(v):
    rows = v.listings.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return lo.with_slug(rows, v.catalog).select("city", "n", "slug", "slug_error")


def a9(v):
    return cat.unambiguous_aliases(v.catalog)


def a10(v):
    """The catalog with some broken rows: nations of one region share code and slug."""
    key = F.col("city_pos")
    broken = v.catalog.withColumns(
        {
            "kato_code": F.when(key % 5 == 1, F.lit("k1")).otherwise(F.col("kato_code")),
            "slug": F.when(key % 6 == 2, F.lit("same")).otherwise(F.col("slug")),
            "name_kk": F.when(key == 4, F.lit("")).otherwise(F.col("name_kk")),
            "aliases": F.when(key % 7 == 3, F.array(F.lit("Общий"))).otherwise(F.col("aliases")),
        }
    )
    return cat.integrity(broken)


def a11(v):
    return cat.district_names(v.catalog)


def _located(v, existing: bool):
    home = F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string"))
    rows = v.messages.select(
        "msg_id", "message", F.lit(None).cast("string").alias("patch_city"),
        F.lit(None).cast("array<string>").alias("patch_districts"),
        (F.when(F.col("msg_id") % 2 == 0, home) if existing else F.lit(None).cast("string")).alias("existing_city"),
        (F.when(F.col("msg_id") % 4 == 0, F.array(F.lit("N"))) if existing else F.lit(None).cast("array<string>")).alias("existing_districts"),
    )
    return lo.resolve(rows, v.catalog, "NATION_0")


def l5(v):
    return _located(v, True).select(
        "msg_id", "city", F.array_join("districts", ",").alias("districts"), "defaulted_city", "error"
    )


_M = r"(?i)(?:^|[^\p{L}\p{N}_])(?:район(?:е|а|у|ом)?|р-н|аудан(?:ы|ында)?)\s+([^,.;]+)"
LEADS = ", ".join(f"'{w}'" for w in lo.NON_LOCATION_LEADS)
L5_SQL = rf"""WITH m AS (SELECT v.msg_id, message, trim(regexp_extract(message, '{_M}', 1)) AS lab, regexp_matches(message, '{_M}') AS marked,
    regexp_replace(message, '{_M}', ' ', 'g') AS bare,
    CASE WHEN msg_id % 2 = 0 THEN 'NATION_' || (user_id % 25) END AS old_city,
    CASE WHEN msg_id % 4 = 0 THEN ['N'] END AS old_districts FROM v_messages v),
texts AS (SELECT msg_id, 'bare' AS role, bare AS raw FROM m UNION ALL SELECT msg_id, 'message', message FROM m
  UNION ALL SELECT msg_id, 'label', lab FROM m WHERE length(lab) >= 3 AND NOT regexp_matches(lab, '\d')
    AND lower(regexp_extract(lab, '^(\S+)', 1)) NOT IN ({LEADS})),
norm AS (SELECT msg_id, role, raw, trim(regexp_replace(replace(replace(lower(nfc_normalize(raw)), 'ß', 'ss'), 'ё', 'е'),
  '[^\p{{L}}\p{{N}}_-]+', ' ', 'g')) AS normal FROM texts),
chit AS (SELECT msg_id, role, city FROM (SELECT msg_id, role, ' ' || normal || ' ' AS t FROM norm) JOIN v_city_aliases
  ON list_bool_or(list_transform(['', 'е', 'а', 'у', 'ом', 'ем', 'ы', 'и', 'я', 'ю'], lambda e: contains(t, ' ' || alias || e || ' ')))
  QUALIFY row_number() OVER (PARTITION BY msg_id, role ORDER BY length(alias) DESC, city_pos) = 1),
wrd AS (SELECT DISTINCT msg_id, role, unnest(string_split_regex(normal, '[ -]+')) AS word FROM norm),
dhit AS (SELECT msg_id, role, city, city_pos, district, district_pos, max(length(alias)) AS n FROM wrd JOIN v_district_aliases
  ON starts_with(word, alias) AND length(word) - length(alias) <= CASE WHEN length(alias) >= 4 THEN 4 ELSE 0 END GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY msg_id, role, city ORDER BY n DESC, district_pos) AS nr FROM dhit),
lab AS (SELECT msg_id, count(*) AS cities, arg_min(city, city_pos) AS lab_city FROM best WHERE role = 'label' AND nr = 1 GROUP BY 1),
named AS (SELECT m.*, coalesce(b.city, CASE WHEN marked AND EXISTS (SELECT 1 FROM dhit d WHERE d.msg_id = m.msg_id
    AND d.role = 'message' AND d.city = c.city) THEN c.city END) AS named_city,
    EXISTS (SELECT 1 FROM norm x WHERE x.msg_id = m.msg_id AND x.role = 'label') AS spoken
  FROM m LEFT JOIN chit b ON b.msg_id = m.msg_id AND b.role = 'bare' LEFT JOIN chit c ON c.msg_id = m.msg_id AND c.role = 'message'),
said AS (SELECT n.*, CASE WHEN named_city IS NULL THEN CASE WHEN lab.cities = 1 THEN lab.lab_city END
    WHEN EXISTS (SELECT 1 FROM best x WHERE x.msg_id = n.msg_id AND x.role = 'label' AND x.city = named_city) THEN named_city END AS exp_city
  FROM named n LEFT JOIN lab ON lab.msg_id = n.msg_id),
msgd AS (SELECT msg_id, city, min(city_pos) AS city_pos, list(district ORDER BY n DESC, district_pos) AS ds FROM dhit WHERE role = 'message' GROUP BY ALL),
cnt AS (SELECT msg_id, count(*) AS cities, arg_min(city, city_pos) AS one_city, arg_min(ds, city_pos) AS one FROM msgd GROUP BY 1),
pick AS (SELECT s.*, coalesce(exp_city, named_city) AS said_city,
    CASE WHEN exp_city IS NOT NULL THEN (SELECT [district] FROM best x WHERE x.msg_id = s.msg_id AND x.role = 'label' AND x.city = exp_city AND nr = 1)
      WHEN named_city IS NOT NULL THEN (SELECT ds FROM msgd x WHERE x.msg_id = s.msg_id AND x.city = named_city) END AS said_ds,
    CASE WHEN exp_city IS NULL AND named_city IS NOT NULL AND NOT EXISTS (SELECT 1 FROM msgd x WHERE x.msg_id = s.msg_id AND x.city = named_city)
      THEN (SELECT arg_min(ds[1], city_pos) FROM msgd x WHERE x.msg_id = s.msg_id) END AS wrong,
    (SELECT ds FROM msgd x WHERE x.msg_id = s.msg_id AND x.city = old_city) AS old_found, coalesce(cnt.cities, 0) AS cities, cnt.one_city, cnt.one
  FROM said s LEFT JOIN cnt ON cnt.msg_id = s.msg_id),
fin AS (SELECT *, CASE WHEN said_city IS NOT NULL THEN said_city WHEN old_city IS NOT NULL THEN old_city
    WHEN cities = 1 THEN one_city ELSE 'NATION_0' END AS city,
    said_city IS NOT NULL OR (old_city IS NOT NULL AND old_found IS NOT NULL) OR (old_city IS NULL AND cities = 1) AS supplied,
    CASE WHEN said_city IS NOT NULL THEN said_ds WHEN old_city IS NOT NULL THEN old_found WHEN cities = 1 THEN [one[1]] END AS ds,
    said_city IS NULL AND old_city IS NULL AND cities > 1 AS several FROM pick),
err AS (SELECT f.*, CASE WHEN wrong IS NOT NULL THEN 'Район «' || wrong || '» не относится к городу ' || named_city || '.'
    WHEN several THEN 'Название района встречается в нескольких городах — укажи город.'
    WHEN c.slug IS NULL THEN 'Город ' || c.name_ru || ' распознан, но сейчас отсутствует в каталоге сайта.' END AS error
  FROM fin f JOIN v_cities c ON c.city = f.city)
SELECT msg_id, CASE WHEN error IS NULL THEN city END AS city,
  CASE WHEN error IS NULL THEN array_to_string(CASE WHEN old_city IS NOT NULL AND (NOT supplied OR (city = old_city AND ds IS NULL AND NOT spoken))
    THEN old_districts ELSE ds END, ',') END AS districts,
  CASE WHEN error IS NULL THEN NOT supplied AND old_city IS NULL END AS defaulted_city, error FROM err"""


def p42(v):
    has = F.col("user_id") % 3 == 0
    return v.messages.select("msg_id", it.dialog_class("message", has).alias("intent"))


P42_SQL = f"""SELECT msg_id, CASE WHEN {_any(it.HELP_MARKERS)} THEN 'help' WHEN {_any(it.MONITOR_MARKERS)} THEN 'show_monitor'
  WHEN {_any(it.SAVED_MARKERS)} THEN 'show_saved' WHEN {_any(it.CRITERIA_MARKERS)} THEN 'show_criteria'
  WHEN has AND ({_any(it.REFINE_MARKERS)} OR (NOT {_any(it.SEARCH_MARKERS)} AND {_any(it.FIELD_MARKERS)})) THEN 'refine'
  WHEN {_any(it.SEARCH_MARKERS)} OR {_any(it.FIELD_MARKERS)} THEN 'search' WHEN has THEN 'refine' ELSE 'help' END AS intent
FROM (SELECT msg_id, lower(trim(message)) AS t, user_id % 3 = 0 AS has FROM v_messages)"""


def _patches(v):
    """A JSON patch per order; kinds of fields and mistakes vary with the key."""
    k = F.col("o_orderkey")
    n = F.floor(F.col("o_totalprice") / 1000).cast("bigint")
    s = [
        F.concat(F.lit('{"city": " Градб ", "max_price_kzt": '), n, F.lit(', "min_price_kzt": "'), n + 5, F.lit('"}')),
        F.concat(F.lit('{"deal_type": "Аренда", "rooms": "'), k % 4, F.lit("-"), k % 4 + 2, F.lit('", "owner_only": true}')),
        F.concat(F.lit('{"rooms": ['), k % 4, F.lit(', "3", 2.0], "districts": [" Речной ", ""], "page_limit": '), k % 30, F.lit("}")),
        F.concat(F.lit('{"rooms": '), k % 3, F.lit(', "rent_period": "'), F.when(k % 2 == 0, F.lit("daily")).otherwise(F.lit("weekly")), F.lit('"}')),
        F.concat(F.lit('{"min_area_m2": '), n, F.lit('.5, "max_area_m2": "40", "districts": ""}')),
        F.lit('{"note": "nothing"}'),
        F.concat(F.lit("no json "), k),
    ]
    text = None
    for i, body in enumerate(s):
        text = F.when(k % 7 == i, body) if text is None else text.when(k % 7 == i, body)
    return v.table("orders").select(k.alias("msg_id"), text.alias("patch"), "o_totalprice")


PATCH_COLS = ("city", "deal_type", "rent_period", "min_price_kzt", "max_price_kzt", "min_area_m2", "max_area_m2", "owner_only", "page_limit")


def p38(v):
    out = it.parse_patches(_patches(v))
    return out.select(
        "msg_id", "patch_ok", *[F.col(f"patch_{c}").alias(c) for c in PATCH_COLS],
        ints("patch_rooms").alias("rooms"), F.array_join("patch_districts", ",").alias("districts"),
    )


P38_CORE = """SELECT o_orderkey AS msg_id, k, key, n,
  CASE k WHEN 2 THEN key % 30 BETWEEN 1 AND 20 WHEN 3 THEN key % 2 = 0 WHEN 5 THEN false WHEN 6 THEN false ELSE true END AS ok
FROM (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderkey AS key, CAST(floor(o_totalprice / 1000) AS BIGINT) AS n FROM orders)"""
P38_FIELDS = """CASE WHEN ok AND k = 0 THEN 'Градб' END AS city, CASE WHEN ok AND k = 1 THEN 'rent' END AS deal_type,
  CASE WHEN ok AND k = 3 THEN 'daily' END AS rent_period, CASE WHEN ok AND k = 0 THEN n END AS min_price_kzt,
  CASE WHEN ok AND k = 0 THEN n + 5 END AS max_price_kzt,
  CASE WHEN ok AND k = 4 THEN least(n + CAST(0.5 AS DOUBLE), 40) END AS min_area_m2,
  CASE WHEN ok AND k = 4 THEN greatest(n + CAST(0.5 AS DOUBLE), 40) END AS max_area_m2,
  CASE WHEN ok AND k = 1 THEN true END AS owner_only, CASE WHEN ok AND k = 2 THEN key % 30 END AS page_limit,
  CASE WHEN NOT ok THEN NULL WHEN k = 1 THEN array_to_string(list_filter([key % 4, key % 4 + 1, key % 4 + 2], lambda x: x > 0), ',')
    WHEN k = 2 THEN array_to_string(list_sort(list_distinct(list_filter([key % 4, 2, 3], lambda x: x > 0))), ',')
    WHEN k = 3 AND key % 3 > 0 THEN CAST(key % 3 AS VARCHAR) END AS rooms,
  CASE WHEN ok AND k = 2 THEN 'Речной' END AS districts"""


def _combined(v):
    patches = it.parse_patches(_patches(v)).drop("patch", "o_totalprice")
    return it.combine(v.messages.join(patches, "msg_id", "left"))


def p40(v):
    return _combined(v).select(
        "msg_id", "from_patch", "deal_type", "rent_period", "min_price_kzt", "max_price_kzt", "owner_only", "page_limit",
        ints("rooms").alias("rooms"),
    )


def p39(v):
    return it.new_criteria(_combined(v)).select(
        "msg_id", "deal_type", "rent_period", "owner_only", "page_limit", "property_type"
    )


def p41(v):
    loc = _located(v, False).select("msg_id", "districts", "defaulted_city", "error")
    rows = _parsed(v).join(loc.where(F.col("error").isNull()), "msg_id")
    return rows.select("msg_id", it.has_signal().alias("signal"))


PAGE_SQL = r"least(greatest(CAST(nullif(regexp_extract(t, '(?:pages?|page_limit|страниц[\p{L}\p{N}_]*)\s*(\d+)', 1), '') AS INT), 1), 20)"
PAGE_SQL = f"CASE WHEN regexp_matches(t, '(?:pages?|page_limit|страниц[\\p{{L}}\\p{{N}}_]*)\\s*(\\d+)') THEN {PAGE_SQL} END"
OWNER_SQL = f"CASE WHEN {_any(it.OWNER_MARKERS)} THEN true END"
COMBINED_CTE = f"""patch AS (SELECT msg_id, ok, {P38_FIELDS} FROM ({P38_CORE})),
txt AS (SELECT msg_id, {DEAL_SQL} AS deal_type, {PERIOD_SQL} AS rent_period, {OWNER_SQL} AS owner_only, {PAGE_SQL} AS page_limit FROM {T}),
prc AS ({PRICE_SQL}), rms AS ({ROOMS_SQL}),
comb AS (SELECT x.msg_id, coalesce(p.ok, false) AS from_patch,
  CASE WHEN p.ok THEN p.deal_type ELSE x.deal_type END AS deal_type,
  CASE WHEN p.ok THEN coalesce(p.rent_period, x.rent_period) ELSE x.rent_period END AS rent_period,
  CASE WHEN p.ok THEN p.min_price_kzt ELSE prc.min_price_kzt END AS min_price_kzt,
  CASE WHEN p.ok THEN p.max_price_kzt ELSE prc.max_price_kzt END AS max_price_kzt,
  CASE WHEN p.ok THEN coalesce(p.owner_only, x.owner_only) ELSE x.owner_only END AS owner_only,
  CASE WHEN p.ok THEN p.page_limit ELSE x.page_limit END AS page_limit,
  CASE WHEN p.ok THEN p.rooms ELSE rms.rooms END AS rooms
FROM txt x JOIN prc USING (msg_id) JOIN rms USING (msg_id) LEFT JOIN patch p ON p.msg_id = x.msg_id)"""

# The ratio told without the library: the longest common block of two ranges, the earliest of equal
# ones, leaves a range on its left and one on its right; all blocks found so are the letters in common.
L6_SQL = """WITH tok AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Старый Гград' WHEN 1 THEN 'Стары Град' WHEN 2 THEN 'Нов-Ргад' ELSE 'Кл' END
    || substr('абвгдежзийклмнопрстуфхцчшщэюя', CAST(o_custkey % 25 + 1 AS INT), 1) AS token FROM orders),
asked AS (SELECT DISTINCT token, lower(token) AS t FROM tok WHERE length(replace(token, ' ', '')) >= 4),
pair AS (SELECT DISTINCT t, alias AS n FROM asked, v_city_aliases),
spot AS (SELECT t, n, i, unnest(range(1, length(n) + 1)) AS j FROM (SELECT *, unnest(range(1, length(t) + 1)) AS i FROM pair)),
run AS (SELECT *, len(list_filter(range(1, length(t) + 1), lambda k: length(substr(n, j, k)) = k AND substr(t, i, k) = substr(n, j, k))) AS k
  FROM spot WHERE substr(t, i, 1) = substr(n, j, 1)),
part AS (SELECT t, n, CAST(1 AS BIGINT) AS a0, CAST(length(t) + 1 AS BIGINT) AS a1, CAST(1 AS BIGINT) AS b0, CAST(length(n) + 1 AS BIGINT) AS b1 FROM pair
  UNION ALL SELECT t, n, side.a0, side.a1, side.b0, side.b1 FROM (
    SELECT t, n, unnest([{'a0': a0, 'a1': -best.i, 'b0': b0, 'b1': -best.j},
      {'a0': best.k - best.i, 'a1': a1, 'b0': best.k - best.j, 'b1': b1}]) AS side
    FROM (SELECT p.t, p.n, a0, a1, b0, b1, max({'k': least(k, a1 - i, b1 - j), 'i': -i, 'j': -j}) AS best
      FROM part p JOIN run r ON p.t = r.t AND p.n = r.n AND i >= a0 AND i < a1 AND j >= b0 AND j < b1 GROUP BY ALL))
  WHERE side.a0 < side.a1 AND side.b0 < side.b1),
block AS (SELECT p.t, p.n, a0, a1, b0, b1, max(least(k, a1 - i, b1 - j)) AS k FROM part p JOIN run r
  ON p.t = r.t AND p.n = r.n AND i >= a0 AND i < a1 AND j >= b0 AND j < b1 GROUP BY p.t, p.n, a0, a1, b0, b1),
ratio AS (SELECT t, n, 2.0 * sum(k) / (length(t) + length(n)) AS ratio FROM block GROUP BY t, n),
by_city AS (SELECT t, city, CAST(max(ratio) AS DOUBLE) AS ratio FROM ratio JOIN v_city_aliases ON n = alias GROUP BY ALL),
best AS (SELECT t, city, ratio, coalesce(lead(ratio) OVER w, 0) AS second, row_number() OVER w AS place FROM by_city
  WINDOW w AS (PARTITION BY t ORDER BY ratio DESC))
SELECT token, city, count(*) AS n FROM tok LEFT JOIN asked USING (token)
LEFT JOIN (SELECT t, city FROM best WHERE place = 1 AND ratio >= 0.82 AND ratio - second >= CAST(0.06 AS DOUBLE)) USING (t)
GROUP BY token, city"""

CHECKS = {
    "P29_normal_text": (p29, sql("SELECT msg_id, normal FROM v_normal", "v_normal")),
    "P30_alias_variants": (
        p30,
        """SELECT n_nationkey, name, CASE WHEN length(name) - 4 >= 4 AND name <> 'Речной' AND name <> 'Новский'
  THEN substr(lower(name), 1, length(name) - 4) || '|' || lower(name) ELSE lower(name) END AS variants
FROM (SELECT n_nationkey, unnest(['Аистовский', 'Новский', 'Мирская', 'Речной', 'Уник' || n_name || 'ское']) AS name FROM nation)""",
    ),
    "P31_deal_type": (_field("deal_type"), sql(f"SELECT msg_id, {DEAL_SQL} AS deal_type FROM {T}", "v_messages")),
    "P32_rent_period": (_field("rent_period"), sql(f"SELECT msg_id, {PERIOD_SQL} AS rent_period FROM {T}", "v_messages")),
    "P33_owner_only": (_field("owner_only"), sql(f"SELECT msg_id, {OWNER_SQL} AS owner_only FROM {T}", "v_messages")),
    "P34_price_bounds": (_field("min_price_kzt", "max_price_kzt"), sql(PRICE_SQL, "v_messages")),
    "P35_area_bounds": (_field("min_area_m2", "max_area_m2"), sql(AREA_SQL, "v_messages")),
    "P36_rooms": (_field("rooms"), sql(ROOMS_SQL, "v_messages")),
    "P37_page_limit": (_field("page_limit"), sql(f"SELECT msg_id, {PAGE_SQL} AS page_limit FROM {T}", "v_messages")),
    "P38_patch_rows": (p38, f"SELECT msg_id, ok AS patch_ok, {P38_FIELDS} FROM ({P38_CORE})"),
    "P39_criteria_from_patch": (
        p39,
        sql(
            "WITH " + COMBINED_CTE + """ SELECT msg_id, deal AS deal_type, CASE WHEN deal = 'rent' THEN rent_period END AS rent_period,
  coalesce(owner_only, false) AS owner_only, coalesce(page_limit, 3) AS page_limit, 'apartment' AS property_type
FROM (SELECT *, CASE WHEN rent_period IS NOT NULL AND (NOT from_patch OR deal_type IS NULL) THEN 'rent' ELSE coalesce(deal_type, 'sale') END AS deal FROM comb)""",
            "v_messages",
        ),
    ),
    "P40_patch_over_text": (p40, sql("WITH " + COMBINED_CTE + " SELECT * FROM comb", "v_messages")),
    "P41_search_signal": (p41, None),
    "P42_dialog_class": (p42, sql(P42_SQL, "v_messages")),
    "L2_city_in_text": (
        l2,
        sql(
            """SELECT msg_id, city FROM v_city_hits
QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY length(alias) DESC, city_pos) = 1""",
            "v_city_hits",
        ),
    ),
    "L3_district_in_city": (
        l3,
        sql(
            """SELECT msg_id, city, district FROM v_district_hits JOIN v_messages USING (msg_id) WHERE city = 'NATION_' || (user_id % 25)
QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY length(alias) DESC, district_pos) = 1""",
            "v_district_hits",
        ),
    ),
    "L4_districts_in_text": (
        l4,
        sql("SELECT msg_id, city, district, max(length(alias)) AS len FROM v_district_hits GROUP BY ALL", "v_district_hits"),
    ),
    "L4_cities_of_label": (
        l4b,
        sql(
            """SELECT label, count(DISTINCT city) AS cities FROM (SELECT DISTINCT lower(l_returnflag) AS low, l_returnflag AS label FROM lineitem
  UNION ALL SELECT 'u' || n_nationkey, 'u' || n_nationkey FROM nation) JOIN v_district_aliases ON alias = low GROUP BY 1""",
            "v_district_aliases",
        ),
    ),
    "L5_resolve_location": (l5, sql(L5_SQL, "v_messages", "v_city_aliases", "v_district_aliases", "v_cities")),
    "L6_fuzzy_city": (l6, sql(L6_SQL, "v_city_aliases", recursive=True)),
    "L7_flat_district_aliases": (
        l7,
        sql(
            """SELECT alias, min(district) AS district FROM v_district_aliases WHERE alias NOT IN (SELECT alias FROM v_city_aliases)
GROUP BY 1 HAVING count(DISTINCT district) = 1""",
            "v_district_aliases", "v_city_aliases",
        ),
    ),
    "L8_city_slug": (
        l8,
        sql(
            """SELECT city, count(*) AS n, slug, CASE WHEN slug IS NULL THEN 'Город ' || name_ru || ' распознан, но сейчас отсутствует в каталоге сайта.' END AS slug_error
FROM v_listings JOIN v_cities USING (city) GROUP BY ALL""",
            "v_listings", "v_cities",
        ),
    ),
    "A9_unambiguous_aliases": (
        a9,
        sql("SELECT alias, min(district) AS district FROM v_district_aliases GROUP BY 1 HAVING count(DISTINCT district) = 1", "v_district_aliases"),
    ),
    "A10_catalog_integrity": (
        a10,
        """SELECT 'duplicate city code' AS problem, 'k1' AS value UNION ALL
SELECT 'duplicate slug', 'same' UNION ALL SELECT 'shared city alias', 'общий' UNION ALL SELECT 'blank city identity', 'k4'""",
    ),
    "A11_district_names": (
        a11,
        sql("SELECT city, 'Аистовский, Новский, Речной, Уник' || c || 'ский' AS names FROM v_cities", "v_cities"),
    ),
}
_FRESH = L5_SQL.replace(
    "CASE WHEN msg_id % 2 = 0 THEN 'NATION_' || (user_id % 25) END AS old_city", "CAST(NULL AS VARCHAR) AS old_city"
).replace("CASE WHEN msg_id % 4 = 0 THEN ['N'] END AS old_districts", "CAST(NULL AS VARCHAR[]) AS old_districts")
CHECKS["P41_search_signal"] = (
    p41,
    sql(
        f"""WITH loc AS ({_FRESH}), r AS ({ROOMS_SQL}), p AS ({PRICE_SQL}), a AS ({AREA_SQL})
SELECT msg_id, rooms IS NOT NULL OR min_price_kzt IS NOT NULL OR max_price_kzt IS NOT NULL OR min_area_m2 IS NOT NULL
  OR max_area_m2 IS NOT NULL OR districts IS NOT NULL OR NOT defaulted_city AS signal
FROM loc JOIN r USING (msg_id) JOIN p USING (msg_id) JOIN a USING (msg_id) WHERE error IS NULL""",
        "v_messages", "v_city_aliases", "v_district_aliases", "v_cities",
    ),
)
CHECKS["P43_location_decision"] = (
    lambda v: _located(v, False).select("msg_id", "city", "defaulted_city", "error"),
    sql(
        _FRESH.replace("""CASE WHEN error IS NULL THEN array_to_string(CASE WHEN old_city IS NOT NULL AND (NOT supplied OR (city = old_city AND ds IS NULL AND NOT spoken))
    THEN old_districts ELSE ds END, ',') END AS districts,""", ""),
        "v_messages", "v_city_aliases", "v_district_aliases", "v_cities",
    ),
)
