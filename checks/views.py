"""The given tables seen as listings, criteria, decisions and so on.

``Views`` builds them in Spark; ``CTES`` states the same rules for the SQL side.
Whole tables are used; nothing is filtered by id.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
POS_SQL = ", ".join(POS)
NOW = "2001-12-01 00:00:00"
LETTERS = "абвгдежзийклмнопрстуфхцчшщэюя"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def listings(self) -> DataFrame:
        line = self.table("lineitem").select(
            *POS, "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
        )
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_name")
        part = self.table("part").select("p_partkey", "p_brand", "p_size")
        joined = (
            line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
        )
        return joined.select(
            *POS,
            F.concat_ws(
                "-",
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.date_format("l_shipdate", "yyyyMMdd"),
            ).alias("external_id"),
            F.col("n_name").alias("city"),
            F.col("l_returnflag").alias("district"),
            F.col("l_returnflag").alias("district_key"),
            (F.floor("l_extendedprice").cast("bigint") * 1000).alias("price_kzt"),
            F.when(F.col("l_quantity") != 50, F.col("l_quantity") + 20).alias("area_m2"),
            F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).cast("int").alias("rooms"),
            F.concat((F.col("l_partkey") % 9 + 1).cast("string"), F.lit("/9")).alias("floor"),
            F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("address"),
            F.when(F.col("l_linestatus") == "O", "owner").otherwise("agent").alias("posted_by"),
            F.col("l_shipdate").cast("timestamp").alias("published_at"),
            F.lit("sale").alias("deal_type"),
            F.lit(None).cast("string").alias("rent_period"),
            F.when(
                F.col("l_orderkey") % 3 == 0, (F.col("l_partkey") % 41 - 20).cast("double") / 2
            ).alias("market_diff_percent"),
        )

    @cached_property
    def criteria(self) -> DataFrame:
        customer = self.table("customer").select(
            "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
        )
        nation = self.table("nation").select("n_nationkey", "n_name")
        low = F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("bigint") * 1000
        asked = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("A"), F.lit("N")))
        rooms = (
            F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit(1), F.lit(2)))
            .when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit(3)))
            .when(F.col("c_mktsegment") == "AUTOMOBILE", F.array(F.lit(2), F.lit(3)))
        )
        return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("user_id"),
            F.col("n_name").alias("city"),
            F.lit("sale").alias("deal_type"),
            F.lit(None).cast("string").alias("rent_period"),
            low.alias("min_price_kzt"),
            (low + 20_000_000).alias("max_price_kzt"),
            rooms.alias("rooms"),
            asked.alias("districts"),
            asked.alias("district_keys"),
            F.lit(30.0).alias("min_area_m2"),
            F.lit(60.0).alias("max_area_m2"),
            (F.col("c_custkey") % 5 == 0).alias("owner_only"),
            (F.col("c_custkey") % 4 + 1).cast("int").alias("page_limit"),
        )

    @cached_property
    def decisions(self) -> DataFrame:
        op = (
            F.when(F.col("event_type") == "purchase", "save")
            .when(F.col("event_type") == "error", "reject")
            .when(F.col("event_type") == "click", "delete_saved")
            .when(F.col("event_type") == "signup", "restore")
            .when(F.col("event_type") == "view", "purge")
        )
        return self.table("events").select(
            "user_id",
            F.get_json_object("props", "$.k").cast("bigint").alias("listing_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("seq"),
            op.alias("op"),
        )

    @cached_property
    def decided_listings(self) -> DataFrame:
        """Listing attributes of the listing ids named by decisions."""
        return self.table("part").select(
            F.col("p_partkey").alias("listing_id"),
            F.concat(F.lit("NATION_"), (F.col("p_partkey") % 5).cast("string")).alias("city"),
            F.element_at(
                F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("p_size") % 3 + 1).cast("int")
            ).alias("district"),
            ((F.floor("p_retailprice").cast("bigint") + F.col("p_size") * 100) * 10_000).alias(
                "price_kzt"
            ),
            F.when(F.col("p_size") != 7, (F.col("p_size") + 25).cast("double")).alias("area_m2"),
            F.when(F.col("p_size") % 11 != 0, F.col("p_size") % 4 + 1).cast("int").alias("rooms"),
        )

    @cached_property
    def actions(self) -> DataFrame:
        return self.table("events").select(
            "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq")
        )

    @cached_property
    def monitors(self) -> DataFrame:
        last = (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("user_id"))
            .agg(F.max("o_orderdate").cast("timestamp").alias("last_checked_at"))
        )
        settings = self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            (F.col("c_custkey") % 4 != 0).alias("is_enabled"),
            (60 * (1 + F.col("c_custkey") % 12)).cast("int").alias("interval_minutes"),
        )
        return settings.join(last, "user_id", "left")

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            (F.col("c_custkey") + 1_000_000).alias("telegram_user_id"),
            F.col("c_name").alias("username"),
        )

    @cached_property
    def pois(self) -> DataFrame:
        kind = F.element_at(
            F.array(F.lit("school"), F.lit("park"), F.lit("metro station")),
            (F.col("s_suppkey") % 3 + 1).cast("int"),
        )
        return self.table("supplier").select(
            kind.alias("category"),
            (43 + (F.col("s_suppkey") % 100) / 1000).alias("lat"),
            (76 + (F.col("s_suppkey") % 37) / 1000).alias("lon"),
        )

    @cached_property
    def address_points(self) -> DataFrame:
        """Known points per (city, address); every seventh address is a miss."""
        p = self.table("part")
        known = F.col("p_partkey") % 7 != 0
        return p.select(
            F.when(F.col("p_partkey") % 2 == 0, "Almaty").otherwise("Astana").alias("city"),
            F.concat(F.lit(" Street "), F.col("p_partkey").cast("string"), F.lit(" ")).alias(
                "address"
            ),
            F.when(known, 43 + (F.col("p_partkey") % 100) / 1000).alias("lat"),
            F.when(known, 76 + (F.col("p_partkey") % 41) / 1000).alias("lon"),
        )


    @cached_property
    def catalog(self) -> DataFrame:
        """Nations as cities with made-up names; three shared districts and one own."""
        key = F.col("n_nationkey")
        letter = F.substring(F.lit(LETTERS), key + 1, F.lit(1))

        def district(pos: int, canonical, name):
            return F.struct(
                F.concat(F.lit("d"), key.cast("string"), F.lit(f"-{pos}")).alias("kato_code"),
                canonical.alias("canonical"),
                name.alias("name_ru"),
                name.alias("name_kk"),
                F.array(canonical).alias("aliases"),
            )

        shared = [("A", "Аистовский"), ("N", "Новский"), ("R", "Речной")]
        districts = F.array(
            *[district(i, F.lit(c), F.lit(n)) for i, (c, n) in enumerate(shared)],
            district(
                3,
                F.concat(F.lit("U"), key.cast("string")),
                F.concat(F.lit("Уник"), letter, F.lit("ский")),
            ),
        )
        return self.table("nation").select(
            key.alias("city_pos"),
            F.concat(F.lit("k"), key.cast("string")).alias("kato_code"),
            F.col("n_name").alias("canonical"),
            F.concat(F.lit("Град"), letter).alias("name_ru"),
            F.concat(F.lit("Кала"), letter).alias("name_kk"),
            F.array(
                F.concat(F.lit("Старый Град"), letter), F.concat(F.lit("Нов–Град"), letter)
            ).alias("aliases"),
            F.when(key % 8 != 7, F.lower("n_name")).alias("slug"),
            districts.alias("districts"),
        )

    @cached_property
    def messages(self) -> DataFrame:
        """A request text per order, and every conversation turn as noise."""
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
        k = F.col("o_orderkey")
        rooms = (k % 5 + 1).cast("string")
        more = (k % 5 + 2).cast("string")
        letter = F.substring(F.lit(LETTERS), (F.col("o_custkey") % 25 + 1).cast("int"), F.lit(1))
        n = F.floor(F.col("o_totalprice") / 10000).cast("bigint")

        def num(extra: int = 0):
            return (n + extra).cast("string")

        texts = [
            [rooms, "-комнатная в Град", letter, "е до ", num(), " млн"],
            ["сниму двушку посуточно в Кала", letter, " от ", num(), " до ", num(10), " тыс"],
            ["от ", num(20), " до ", num(), " млн"],
            ["район Аистовский, ", rooms, " или ", more, " комнаты"],
            ["в Уник", letter, "ском районе до ", num(30), " млн от хозяина"],
            ["ТРЁХкомнатная от ", num(), " м2 до ", num(30), " м2 страниц ", (k % 30).cast("string")],
            ["покажи ещё список"],
            ["куплю однушку, Старый Град", letter, " от ", num(), ",5 млн"],
            ["район Речной в Нов-Град", letter, "у: ", num(), " млн, 2-4 комнаты"],
            ["только помесячно, речной, nation_", (k % 25).cast("string")],
        ]
        text = None
        for i, parts in enumerate(texts):
            body = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
            text = F.when(k % 10 == i, body) if text is None else text.when(k % 10 == i, body)
        asked = o.select(
            k.alias("msg_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            text.alias("message"),
        )
        noise = self.table("conversations").select(
            (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("msg_id"),
            F.col("conv_id").alias("user_id"),
            F.lit(NOW).cast("timestamp").alias("ts"),
            F.col("text").alias("message"),
        )
        return asked.unionByName(noise)


_CASE_OP = """CASE event_type WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'reject'
  WHEN 'click' THEN 'delete_saved' WHEN 'signup' THEN 'restore' WHEN 'view' THEN 'purge' END"""

# name -> (names it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "v_listings": (
        (),
        f"""
SELECT {POS_SQL},
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS external_id,
  n_name AS city, l_returnflag AS district,
  CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS price_kzt,
  CASE WHEN l_quantity <> 50 THEN l_quantity + 20 END AS area_m2,
  CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS rooms,
  (l_partkey % 9 + 1) || '/9' AS floor,
  p_brand || ' ' || p_size AS address,
  CASE WHEN l_linestatus = 'O' THEN 'owner' ELSE 'agent' END AS posted_by,
  l_shipdate AS published_at, 'sale' AS deal_type,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey % 41 - 20 AS DOUBLE) / 2 END AS market_diff_percent
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey""",
    ),
    "v_criteria": (
        (),
        """
SELECT c_custkey AS user_id, n_name AS city, 'sale' AS deal_type,
  CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) * 1000 AS min_price_kzt,
  CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) * 1000 + 20000000 AS max_price_kzt,
  CASE c_mktsegment WHEN 'BUILDING' THEN [1, 2] WHEN 'MACHINERY' THEN [3] WHEN 'AUTOMOBILE' THEN [2, 3] END AS rooms,
  CASE WHEN c_custkey % 3 = 0 THEN ['A', 'N'] END AS districts,
  30.0 AS min_area_m2, 60.0 AS max_area_m2, c_custkey % 5 = 0 AS owner_only, c_custkey % 4 + 1 AS page_limit
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "v_pairs": (
        ("v_listings", "v_criteria"),
        """
SELECT c.user_id, l.*, c.max_price_kzt, c.rooms AS want_rooms, c.districts AS want_districts
FROM v_criteria c JOIN v_listings l ON c.city = l.city AND c.deal_type = l.deal_type
WHERE (c.rooms IS NULL OR l.rooms IS NULL OR list_contains(c.rooms, l.rooms))
  AND (c.districts IS NULL OR list_contains(c.districts, l.district))
  AND l.price_kzt BETWEEN c.min_price_kzt AND c.max_price_kzt
  AND (l.area_m2 IS NULL OR l.area_m2 BETWEEN c.min_area_m2 AND c.max_area_m2)
  AND (NOT c.owner_only OR l.posted_by = 'owner')""",
    ),
    "v_decisions": (
        (),
        f"""
SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS listing_id, ts,
  event_id AS seq, {_CASE_OP} AS op FROM events""",
    ),
    "v_decided_listings": (
        (),
        """
SELECT p_partkey AS listing_id, 'NATION_' || (p_partkey % 5) AS city,
  ['A', 'N', 'R'][p_size % 3 + 1] AS district,
  (CAST(floor(p_retailprice) AS BIGINT) + p_size * 100) * 10000 AS price_kzt,
  CASE WHEN p_size <> 7 THEN CAST(p_size + 25 AS DOUBLE) END AS area_m2,
  CASE WHEN p_size % 11 <> 0 THEN p_size % 4 + 1 END AS rooms
FROM part""",
    ),
    "v_monitors": (
        (),
        """
SELECT c_custkey AS user_id, c_custkey % 4 <> 0 AS is_enabled,
  60 * (1 + c_custkey % 12) AS interval_minutes, last_checked_at
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_checked_at FROM orders GROUP BY 1)
  ON o_custkey = c_custkey""",
    ),
    "v_users": (
        (),
        "SELECT c_custkey AS user_id, c_custkey + 1000000 AS telegram_user_id, c_name AS username FROM customer",
    ),
    "v_pois": (
        (),
        """
SELECT ['school', 'park', 'metro station'][s_suppkey % 3 + 1] AS category,
  43 + (s_suppkey % 100) / 1000 AS lat, 76 + (s_suppkey % 37) / 1000 AS lon FROM supplier""",
    ),
    "v_address_points": (
        (),
        """
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Almaty' ELSE 'Astana' END AS city,
  ' Street ' || p_partkey || ' ' AS address,
  CASE WHEN p_partkey % 7 <> 0 THEN 43 + (p_partkey % 100) / 1000 END AS lat,
  CASE WHEN p_partkey % 7 <> 0 THEN 76 + (p_partkey % 41) / 1000 END AS lon
FROM part""",
    ),
}


CTES |= {
    "v_cities": (
        (),
        f"""
SELECT n_nationkey AS city_pos, n_name AS city, 'Град' || c AS name_ru, 'Кала' || c AS name_kk, c,
  CASE WHEN n_nationkey % 8 <> 7 THEN lower(n_name) END AS slug
FROM (SELECT *, substr('{LETTERS}', n_nationkey + 1, 1) AS c FROM nation)""",
    ),
    "v_city_aliases": (
        ("v_cities",),
        """
SELECT DISTINCT city, city_pos, unnest([lower(city), lower(name_ru), lower(name_kk), 'старый град' || c, 'нов-град' || c]) AS alias
FROM v_cities""",
    ),
    "v_district_aliases": (
        ("v_cities",),
        """
SELECT city, city_pos, 'A' AS district, 0 AS district_pos, unnest(['a', 'аистовский', 'аистов']) AS alias FROM v_cities
UNION ALL SELECT city, city_pos, 'N', 1, unnest(['n', 'новский']) FROM v_cities
UNION ALL SELECT city, city_pos, 'R', 2, unnest(['r', 'речной']) FROM v_cities
UNION ALL SELECT city, city_pos, 'U' || city_pos, 3,
  unnest(['u' || city_pos, 'уник' || replace(c, 'ё', 'е') || 'ский', 'уник' || c]) FROM v_cities""",
    ),
    "v_messages": (
        (),
        f"""
SELECT o_orderkey AS msg_id, o_custkey AS user_id, o_orderdate AS ts, CASE k
  WHEN 0 THEN r || '-комнатная в Град' || c || 'е до ' || n || ' млн'
  WHEN 1 THEN 'сниму двушку посуточно в Кала' || c || ' от ' || n || ' до ' || (n + 10) || ' тыс'
  WHEN 2 THEN 'от ' || (n + 20) || ' до ' || n || ' млн'
  WHEN 3 THEN 'район Аистовский, ' || r || ' или ' || (r + 1) || ' комнаты'
  WHEN 4 THEN 'в Уник' || c || 'ском районе до ' || (n + 30) || ' млн от хозяина'
  WHEN 5 THEN 'ТРЁХкомнатная от ' || n || ' м2 до ' || (n + 30) || ' м2 страниц ' || (o_orderkey % 30)
  WHEN 6 THEN 'покажи ещё' || chr(160) || 'список'
  WHEN 7 THEN 'куплю однушку, Старый Град' || c || ' от ' || n || ',5 млн'
  WHEN 8 THEN 'район Речной в Нов-Град' || c || 'у: ' || n || ' млн, 2-4 комнаты'
  ELSE 'только помесячно, речной, nation_' || (o_orderkey % 25) END AS message
FROM (SELECT *, o_orderkey % 10 AS k, o_orderkey % 5 + 1 AS r, substr('{LETTERS}', CAST(o_custkey % 25 + 1 AS INT), 1) AS c,
  CAST(floor(o_totalprice / 10000) AS BIGINT) AS n FROM orders)
UNION ALL SELECT conv_id * 1000 + turn + 1000000000, conv_id, TIMESTAMP '{NOW}', text FROM conversations""",
    ),
    "v_normal": (
        ("v_messages",),
        """
SELECT msg_id, message, trim(regexp_replace(replace(replace(lower(nfc_normalize(message)), 'ß', 'ss'), 'ё', 'е'),
  '[^\\p{L}\\p{N}_-]+', ' ', 'g')) AS normal FROM v_messages""",
    ),
    "v_city_hits": (
        ("v_normal", "v_city_aliases"),
        """
SELECT msg_id, city, city_pos, alias FROM (SELECT msg_id, ' ' || normal || ' ' AS t FROM v_normal) JOIN v_city_aliases
  ON list_bool_or(list_transform(['', 'е', 'а', 'у', 'ом', 'ем', 'ы', 'и', 'я', 'ю'],
    lambda e: contains(t, ' ' || alias || e || ' ')))""",
    ),
    "v_words": (
        ("v_normal",),
        "SELECT DISTINCT msg_id, unnest(string_split_regex(normal, '[ -]+')) AS word FROM v_normal",
    ),
    "v_district_hits": (
        ("v_words", "v_district_aliases"),
        """
SELECT msg_id, city, city_pos, district, district_pos, alias FROM v_words JOIN v_district_aliases
  ON starts_with(word, alias) AND length(word) - length(alias) <= CASE WHEN length(alias) >= 4 THEN 4 ELSE 0 END""",
    ),
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` under the CTEs it names and those they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body
    head = ",\n".join(f"{name} AS ({CTES[name][1]})" for name in ordered)
    body = body.strip()
    word = "WITH RECURSIVE" if recursive else "WITH"
    if body.upper().startswith("WITH "):
        return f"{word} {head},\n{body[5:]}"
    return f"{word} {head}\n{body}"


def crawled(v: Views) -> DataFrame:
    """Listings as if extracted: district labels in Russian, as the cards give them."""
    label = F.create_map(F.lit("A"), F.lit("Аистовский р-н"), F.lit("N"), F.lit("Новский р-н"), F.lit("R"), F.lit("Речной р-н"))
    return v.listings.drop("district_key").withColumn("district", F.element_at(label, F.col("district")))
