import pytest
from pyspark.sql import functions as F

from kvartal.functions import location_text as lt
from kvartal.operators import locate as lo

CASES = [
    # message, patch city, patch districts, old city, old districts -> city, districts, defaulted or error part
    ("двушка в Алмате", None, None, None, None, ("Almaty", None, False)),
    ("квартира в нур-султане", None, None, None, None, ("Astana", None, False)),
    # a hyphen of an alias must be there; only its blanks match both
    ("квартира в нур султане", None, None, None, None, ("Almaty", None, True)),
    ("нур-султан, Есильский район", None, None, None, None, ("Astana", ["Есильский"], False)),
    ("просто квартира", None, None, None, None, ("Almaty", None, True)),
    ("Бостандыкском районе", None, None, None, None, ("Almaty", ["Бостандыкский"], False)),
    ("есиль", None, None, None, None, "в нескольких городах"),
    ("в Астане, Медеуский район", None, None, None, None, "не относится к городу Astana"),
    ("в Медеуском районе Алматы", None, None, None, None, ("Almaty", ["Медеуский"], False)),
    # the marker swallows the city, and no district of it is named
    ("район до 45 млн в Астане", None, None, None, None, ("Almaty", None, True)),
    ("район до 45 млн, в Астане", None, None, None, None, ("Astana", None, False)),
    ("квартира", "Алмата", None, None, None, ("Almaty", None, False)),
    ("квартира", "Шымкнет", None, None, None, ("Shymkent", None, False)),
    ("квартира", "Париж", None, None, None, "Город «Париж» не удалось распознать."),
    ("квартира", None, ["Медео"], None, None, ("Almaty", ["Медеуский"], False)),
    ("квартира", "Астана", ["Медео"], None, None, "Район «Медео» не относится к городу Astana."),
    ("квартира", "Астана", ["Нигде"], None, None, "Доступные районы: Есильский район, Сарыаркинский район."),
    ("квартира", None, ["Есиль"], None, None, "Район «Есиль» встречается в нескольких городах"),
    ("в Шу", None, None, None, None, "Город Шу распознан"),
    ("шурум", None, None, None, None, ("Almaty", None, True)),
    ("подешевле", None, None, "Astana", ["Есильский"], ("Astana", ["Есильский"], False)),
    ("есиль", None, None, "Astana", None, ("Astana", ["Есильский"], False)),
    ("в Алматы", None, None, "Astana", ["Есильский"], ("Almaty", None, False)),
    ("в Астане", None, None, "Astana", ["Есильский"], ("Astana", ["Есильский"], False)),
    ("алмалинская улица", None, None, None, None, ("Almaty", ["Алмалинский"], False)),
]


@pytest.fixture(scope="module")
def resolved(spark, catalog):
    rows = [(i, *c[:5]) for i, c in enumerate(CASES)]
    schema = "msg_id long, message string, patch_city string, patch_districts array<string>, existing_city string, existing_districts array<string>"
    out = lo.resolve(spark.createDataFrame(rows, schema), catalog, "Almaty").collect()
    return {r.msg_id: r for r in out}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] + "/" + str(c[1]) for c in CASES])
def test_location_requests(resolved, i):
    want, got = CASES[i][5], resolved[i]
    if isinstance(want, str):
        assert got.error is not None and want in got.error
        assert got.city is None
    else:
        assert got.error is None
        assert (got.city, got.districts, got.defaulted_city) == want


def test_normal_form(spark):
    df = spark.createDataFrame([("Ёлки–палки, «ДОМ»  Ⅳ",)], "t string")
    assert df.select(lt.normal("t")).first()[0] == "елки-палки дом iv"


def test_district_key_uses_label_then_address(spark, catalog):
    rows = [("Almaty", "Медеуский р-н", None), ("Almaty", None, "Алматы, Бостандыкский р-н"), ("Astana", "Медеуский р-н", None)]
    df = spark.createDataFrame(rows, "city string, district string, address string")
    got = {(r.city, r.district): r.district_key for r in lo.with_district_key(df, catalog).collect()}
    assert got == {("Almaty", "Медеуский р-н"): "Медеуский", ("Almaty", None): "Бостандыкский", ("Astana", "Медеуский р-н"): None}


def test_hits_equal_a_scan_of_every_pattern(spark, catalog):
    """The word join finds what testing every alias pattern on every text finds."""
    import re

    from kvartal.sources import catalog as cat

    texts = ["алматы", "алмате и астаной", "алма ата", "алма-атой", "нур-султанский", "шу", "шуу", "медеуская есильском", "аль фарабийском", "бостандықская"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "msg_id long, normal string")
    got = {(r.msg_id, r.city, r.alias) for r in lo.city_hits(df, ["msg_id"], catalog).collect()}
    got_d = {(r.msg_id, r.district, r.alias) for r in lo.district_hits(df, ["msg_id"], catalog).collect()}
    end = "(?:е|а|у|ом|ем|ы|и|я|ю)?"

    def rx(alias, tail):
        return re.compile(rf"(?<!\w){alias.replace(' ', '[ -]+')}{tail}(?!\w)")

    want = {
        (i, a.city, a.alias) for a in cat.city_aliases(catalog).collect() for i, t in enumerate(texts) if rx(a.alias, end).search(t)
    }
    want_d = {
        (i, a.district, a.alias) for a in cat.district_aliases(catalog).collect() for i, t in enumerate(texts)
        if rx(a.alias, r"\w{0,4}" if len(a.alias.replace(" ", "")) >= 4 else "").search(t)
    }
    assert got == want and got_d == want_d


def test_fuzzy_city_equals_every_ratio(spark, catalog):
    """The bounded search gives what scoring every city in full gives."""
    import difflib

    from kvartal.sources import catalog as cat

    names = {}
    rows = cat.cities(catalog).select("canonical", F.explode(cat.all_names()).alias("n")).select("canonical", lt.normal("n").alias("n"))
    for r in rows.collect():
        names.setdefault(r.canonical, set()).add(r.n)

    def full(token):
        if len(token.replace(" ", "")) < 4:
            return None
        best = {c: max(difflib.SequenceMatcher(None, token, n).ratio() for n in ns) for c, ns in names.items()}
        first, second = sorted(best.values(), reverse=True)[:2]
        return max(best, key=best.get) if first >= 0.82 and first - second >= 0.06 else None

    tokens = ["алмаатa", "алматта", "астанаа", "астна", "шымкет", "шмкент", "нурсултан", "шу", "шуш", "париж", "алмастана", "almati"]
    got = {r.token: r.city for r in lo.fuzzy_city(spark.createDataFrame([(t,) for t in tokens], "token string"), catalog).collect()}
    assert got == {t: full(t) for t in tokens}
    assert sum(c is not None for c in got.values()) >= 5


def test_words_are_cut_no_shorter_than_an_alias_may_be(spark):
    forms = lt.district_word_forms(F.col("w"))
    got = {r.w: r.f for r in spark.createDataFrame([("юг",), ("речно",), ("речному",), ("аистовском",)], "w string").select("w", forms.alias("f")).collect()}
    assert got["юг"] == ["юг"] and got["речно"] == ["речно", "речн"] and got["речному"] == ["речному", "речном", "речно", "речн"]
    assert got["аистовском"] == ["аистовском"[: 10 - k] for k in range(5)]
