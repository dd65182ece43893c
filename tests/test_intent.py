import pytest
from pyspark.sql import functions as F

from kvartal.operators import intent as it

TEXTS = {
    "2-комнатная в Алматы до 45 млн": {"rooms": [2], "max_price_kzt": 45_000_000},
    "двухкомнатная": {"rooms": [2]},
    "двушка или трёшка": {"rooms": [2, 3]},
    "1 или 2 комнаты от 30 до 50 млн": {"rooms": [1, 2], "min_price_kzt": 30_000_000, "max_price_kzt": 50_000_000},
    "от 50 до 30 млн": {"max_price_kzt": 30_000_000},
    "от 50 млн, до 30 млн": {"min_price_kzt": 30_000_000, "max_price_kzt": 50_000_000},
    "300 тыс": {"max_price_kzt": 300_000},
    "300 тыс и 20 млн": {},
    "не дороже 1,5 млн": {"max_price_kzt": 1_500_000},
    "от 50 до 80 m2": {"min_price_kzt": 50_000_000, "max_price_kzt": 80_000_000, "min_area_m2": 50.0, "max_area_m2": 80.0},
    "от 40 м2": {"min_area_m2": 40.0},
    "сниму посуточно": {"deal_type": "rent", "rent_period": "daily"},
    "по часам": {"rent_period": "hourly"},
    "куплю от хозяина": {"deal_type": "sale", "owner_only": True},
    "страниц 50": {"page_limit": 20},
    "2-4 комнаты": {"rooms": [2, 3, 4]},
    "привет": {},
}


def test_texts(spark):
    rows = it.parse_text(spark.createDataFrame([(t,) for t in TEXTS], "message string")).collect()
    for row in rows:
        got = {k: v for k, v in row.asDict().items() if k != "message" and v is not None}
        assert got == TEXTS[row.message], row.message


PATCHES = [
    ('{"city":" Алматы ","min_price_kzt":50,"max_price_kzt":"10"}', {"city": "Алматы", "min_price_kzt": 10, "max_price_kzt": 50}),
    ('{"rooms":"2-3"}', {"rooms": [2, 3]}),
    ('{"rooms":[1,"2 и 4",3.9,0]}', {"rooms": [1, 2, 3, 4]}),
    ('{"rooms":3}', {"rooms": [3]}),
    ('{"deal_type":"Снять","rent_period":"daily","owner_only":false}', {"deal_type": "rent", "rent_period": "daily", "owner_only": False}),
    ('{"deal_type":"lease","rooms":2}', None),
    ('{"page_limit":21,"rooms":2}', None),
    ('{"page_limit":"7.9"}', {"page_limit": 7}),
    ('{"min_area_m2":-1}', None),
    ('{"districts":[" a ",""," b"]}', {"districts": ["a", "b"]}),
    ('{"districts":"", "city":null}', None),
    ("[1]", None),
    ("{", None),
]


@pytest.mark.parametrize(("text", "want"), PATCHES)
def test_patches(spark, text, want):
    row = it.parse_patches(spark.createDataFrame([(text,)], "patch string")).first().asDict()
    assert row.pop("patch_ok") is (want is not None)
    row.pop("patch")
    assert {k.removeprefix("patch_"): v for k, v in row.items() if v is not None} == (want or {})


@pytest.mark.parametrize(
    ("text", "has", "want"),
    [
        ("что умеешь", False, "help"), ("интервал 6h", True, "show_monitor"), ("покажи сохранённые", True, "show_saved"),
        ("мои критерии", False, "show_criteria"), ("только двушки", True, "refine"), ("ищу двушку", True, "search"),
        ("до 40 млн", True, "refine"), ("до 40 млн", False, "search"), ("ну", True, "refine"), ("ну", False, "help"),
    ],
)
def test_dialog_class(spark, text, has, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text, has)], "t string, has boolean")
    assert df.select(it.dialog_class("t", F.col("has"))).first()[0] == want


def test_wide_room_ranges_keep_every_count(spark):
    rows = spark.createDataFrame([("1-1500 комнат",), ("1-900 комнат",)], "message string")
    got = [r.rooms for r in rows.select(it.rooms(F.col("message")).alias("rooms")).collect()]
    assert got == [list(range(1, 1501)), list(range(1, 901))]
