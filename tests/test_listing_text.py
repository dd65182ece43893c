import pytest
from pyspark.sql import functions as F

from kvartal.functions import interval, listing_text as lt, money


def value(spark, text, build):
    return spark.createDataFrame([(text,)], "t string").select(build("t").alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("build", "text", "want"),
    [
        (lt.price, "от 35 000 000 ₸", 35_000_000),
        (lt.price, "350", None),
        (lt.price, "1234 ₸", 1234),
        (lt.rooms, "2-комнатная квартира", 2),
        (lt.rooms, "Количество комнат: 3", 3),
        (lt.rooms, "студия", None),
        (lt.area, "потолки 2.7м, 58,5 м²", 58.5),
        (lt.area, "41 кв. м", 41.0),
        (lt.area, "потолки 2.7м", None),
        (lt.floor, "5/12", "5/12"),
        (lt.floor, "535/2", None),
        (lt.floor, "120/240", None),
        (lt.floor, "9/5", None),
        (lt.floor, "Герцена 535/2 · этаж 4 / 7", "4/7"),
        (lt.district_label, "Алматы, Бостандыкский р-н | Навои", "Бостандыкский р-н"),
        (lt.district_label, "Алматы", None),
        (lt.market_diff, "<b>На 9.2% дешевле</b>", -9.2),
        (lt.market_diff, "на 3,5 % ДОРОЖЕ", 3.5),
        (lt.title_address, "Продажа №12: Навои 10, Алматы — за 35 млн — сайт", "Навои 10, Алматы"),
        (lt.listing_id, "/a/show/123?x=1", "123"),
        (lt.display_url, "https://m.example.kz/a/show/1?x#y", "https://example.kz/a/show/1"),
        (interval.interval_minutes, " 6H ", 360),
        (interval.interval_minutes, "10m", None),
        (interval.interval_minutes, "8d", None),
        (interval.interval_minutes, "6 hours", None),
    ],
)
def test_text_rules(spark, build, text, want):
    assert value(spark, text, build) == want


def test_photos_are_distinct_and_one_size(spark):
    html = (
        '<img src="https://x.kcdn.online/content/b/banner-750x470.jpg">'
        '<img src="https://x.kcdn.online/webp/8d/1-120x90.jpg"><img src="https://x.kcdn.online/webp/8d/1-full.jpg">'
        '<img src="https://x.kcdn.kz/webp/8d/2-400x300.png">'
    )
    assert value(spark, html, lt.photos) == [
        "https://x.kcdn.online/webp/8d/1-750x470.jpg",
        "https://x.kcdn.kz/webp/8d/2-750x470.jpg",
    ]


def test_blocked_needs_a_marker_and_no_content(spark):
    rows = [("captcha", None), ("captcha a-card", None), ("plain", 429), ("plain", 200), (None, None)]
    df = spark.createDataFrame(rows, "html string, status int")
    got = [r[0] for r in df.select(lt.is_blocked("html", "status")).collect()]
    assert got == [True, False, True, False, False]


def test_mortgage_matches_the_annuity_formula(spark):
    df = spark.createDataFrame([(35_000_000,), (0,)], "p bigint")
    principal = money.principal("p")
    monthly = money.monthly_payment(principal)
    got = df.select(monthly.alias("m"), money.overpayment(principal, monthly).alias("o")).collect()
    loan, rate = int(35_000_000 * 0.8), 17.5 / 100 / 12
    want = round(loan * rate * (1 + rate) ** 240 / ((1 + rate) ** 240 - 1))
    assert (got[0]["m"], got[0]["o"]) == (want, want * 240 - loan)
    assert (got[1]["m"], got[1]["o"]) == (0, 0)


def test_days_on_market(spark):
    df = spark.sql(
        "select * from values (timestamp'2026-01-01 00:00:00'), (timestamp'2026-02-01 00:00:00'), (cast(null as timestamp)) t(p)"
    )
    now = F.lit("2026-01-10 23:00:00").cast("timestamp")
    assert [r[0] for r in df.select(money.days_on_market("p", now)).collect()] == [9, 0, None]


def test_dates_without_a_zone_are_utc_in_any_session(spark):
    kept = spark.conf.get("spark.sql.session.timeZone")
    page = '"createdAt":"2024-07-11"'
    rows = [(page, None), ("", "2024-07-11T00:00:00"), ("", "2024-07-11"), ("", "2024-07-11T05:00:00+05:00")]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Almaty")
        df = spark.createDataFrame(rows, "html string, attr string")
        at = lt.published_at("html", "attr", F.lit(None).cast("string"), F.lit(None).cast("string"))
        got = [r.s for r in df.select(F.unix_seconds(at).alias("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)
    assert got == [1720656000] * 4
