import math
import random

from pyspark.sql import functions as F

from kvartal.operators import enrich as en
from kvartal.operators import match as m

CRITERIA = (
    "user_id long, city string, deal_type string, rent_period string, min_price_kzt long, max_price_kzt long, rooms array<int>,"
    " districts array<string>, district_keys array<string>, min_area_m2 double, max_area_m2 double, owner_only boolean"
)
LISTING = (
    "external_id string, city string, deal_type string, rent_period string, price_kzt long, rooms int, area_m2 double,"
    " district_key string, posted_by string"
)


def brute(c, x, strict):
    if (c[1], c[2]) != (x[1], x[2]):
        return False
    if c[2] == "rent" and (x[3] or "monthly") != (c[3] or "monthly"):
        return False
    if c[6] and x[5] is not None and x[5] not in c[6]:
        return False
    for value, low, high in ((x[4], c[4], c[5]), (x[6], c[9], c[10])):
        if value is not None and ((low is not None and value < low) or (high is not None and value > high)):
            return False
    if c[11] and x[8] != "owner":
        return False
    if c[7]:
        if not c[8] or (x[7] is None and strict) or (x[7] is not None and x[7] not in c[8]):
            return False
    return True


def test_match_equals_brute_force(spark):
    rnd = random.Random(3)
    pick = lambda *xs: rnd.choice(xs)
    listings = [
        (str(i), pick("A", "A", "A", "B"), pick("sale", "sale", "rent"), pick(None, "daily"),
         pick(None, 20_000_000, rnd.randrange(1, 10**8)), pick(None, 1, 2, 3), pick(None, 40.0, 70.5), pick(None, "x", "y"), pick(None, "owner", "agent"))
        for i in range(400)
    ]
    criteria = []
    for u in range(40):
        low = pick(None, 0, rnd.randrange(10**8))
        high = pick(None, 20_000_000, (low or 0) + rnd.randrange(10**8))
        asked = pick(None, ["x"], ["zz"])
        criteria.append(
            (u, pick("A", "B"), pick("sale", "rent"), pick(None, "daily"), low, high, pick(None, [1, 2]), asked,
             None if asked is None else [d for d in asked if d != "zz"], pick(None, 50.0), pick(None, 80.0), pick(True, False))
        )
    c, x = spark.createDataFrame(criteria, CRITERIA), spark.createDataFrame(listings, LISTING)
    for strict in (False, True):
        got = sorted((r.user_id, r.external_id) for r in m.match(c, x, strict).collect())
        want = sorted((a[0], b[0]) for a in criteria for b in listings if brute(a, b, strict))
        assert got == want


def test_clones_keep_the_cheapest_at_the_first_place(spark):
    rows = [
        ("1", 30, 2, 58.5, "6/9", "Навои 10", 1), ("2", 25, 2, 58.5, "6 /9", " навои  10", 2), ("3", None, 2, 58.5, "6/9", "Навои 10", 3),
        ("4", 20, 2, 58.5, None, "Навои 10", 4), ("5", 10, 2, 58.5, "6/9", "Навои", 5), ("6", 25, 2, 58.54, "6/9", "НАВОИ 10", 6),
    ]
    df = spark.createDataFrame(rows, "external_id string, price_kzt long, rooms int, area_m2 double, floor string, address string, pos int")
    df = df.withColumn("city", F.lit("A"))
    out = m.collapse_clones(df, ["city"], ["pos"])
    got = [(r.external_id, r.place.pos) for r in out.orderBy("place").collect()]
    assert got == [("2", 1), ("4", 4), ("5", 5)]
    again = m.collapse_clones(out.drop("place"), ["city"], ["pos"])
    assert again.count() == 3


def test_nearby_equals_brute_force(spark):
    rnd = random.Random(9)
    points = [(43 + rnd.random() / 5, 76 + rnd.random() / 5) for _ in range(60)] + [(0.001, -0.001), (-60.2, 30.0)]
    pois = [("school", 43 + rnd.random() / 5, 76 + rnd.random() / 5) for _ in range(300)] + [
        ("park", -0.001, 0.001), ("park", -60.2, 30.0355), ("park", -60.2, 30.0365),
    ]
    got = {
        (r.lat, r.lon, r.category): (r.places, r.nearest_m)
        for r in en.nearby(
            spark.createDataFrame(points, "lat double, lon double"), spark.createDataFrame(pois, "category string, lat double, lon double"),
            rows_per_split=3,
        ).collect()
    }

    def metres(a, b, c, d):
        p1, p2 = math.radians(a), math.radians(c)
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000.0 * math.asin(math.sqrt(h))

    want = {}
    for a, b in points:
        for kind, c, d in pois:
            if (dist := metres(a, b, c, d)) <= 2000:
                want.setdefault((a, b, kind), []).append(dist)
    assert got == {k: (len(v), round(min(v))) for k, v in want.items()}


def test_first_flats_equal_the_cut_of_all_flats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "FIRST_SLICE", 20)
    rnd = random.Random(11)
    listings = [
        (f"x{i}", rnd.choice("ab"), "sale", None, rnd.choice([None, rnd.randint(1, 40)]), rnd.randint(1, 3), float(rnd.randint(30, 33)),
         "1/9", f"дом {rnd.randint(1, 12)}", rnd.choice(["owner", "agent"]), rnd.choice("AN"), rnd.choice([None, *range(60)]), i)
        for i in range(900)
    ]
    schema = (
        "external_id string, city string, deal_type string, rent_period string, price_kzt long, rooms int, area_m2 double, floor string,"
        "address string, posted_by string, district_key string, day int, pos int"
    )
    criteria = [
        (u, rnd.choice("abc"), "sale", None, rnd.randint(0, 30), rnd.randint(10, 45), rnd.choice([None, [1], [2, 3]]),
         *(rnd.choice([(None, None), (["A"], ["A"])]),), None, None, rnd.random() < 0.4)
        for u in range(40)
    ]
    criteria = [(*c[:7], *c[7], *c[8:]) for c in criteria]
    asked = spark.createDataFrame(
        criteria,
        "user_id long, city string, deal_type string, rent_period string, min_price_kzt long, max_price_kzt long, rooms array<int>,"
        "districts array<string>, district_keys array<string>, min_area_m2 double, max_area_m2 double, owner_only boolean",
    )
    offered = spark.createDataFrame(listings, schema)
    order = ["day", "pos"]
    assert len(m.slices(offered, "day")) > 2
    every = m.top_per_user(m.flats(asked, offered, order), ["place"])
    first = m.first_flats(asked, offered, order, str(tmp_path))

    def shown(rows):
        return sorted((r.user_id, r["rank"], r.external_id, r.flat) for r in rows.collect())

    assert shown(first) == shown(every) and first.count() > 50
