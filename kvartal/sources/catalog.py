"""Location catalog: nested JSON to city, district and alias tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvartal.functions import location_text as lt

_NAMES = [
    T.StructField("kato_code", T.StringType()),
    T.StructField("canonical", T.StringType()),
    T.StructField("name_ru", T.StringType()),
    T.StructField("name_kk", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
]
DISTRICT = T.StructType(_NAMES)
CITY = T.StructType(
    [
        *_NAMES,
        T.StructField("slug", T.StringType()),
        T.StructField("districts", T.ArrayType(DISTRICT)),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("cities", T.ArrayType(CITY)),
    ]
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per city in catalog order, districts nested."""
    document = spark.read.schema(DOCUMENT).json(path, multiLine=True)
    return document.select(F.posexplode("cities").alias("city_pos", "c")).select("city_pos", "c.*")


def cities(catalog: DataFrame) -> DataFrame:
    return catalog.select("city_pos", "kato_code", "canonical", "name_ru", "name_kk", "aliases", "slug")


def districts(catalog: DataFrame) -> DataFrame:
    rows = catalog.select(
        "city_pos",
        F.col("canonical").alias("city"),
        F.posexplode("districts").alias("district_pos", "d"),
    )
    return rows.select("city_pos", "city", "district_pos", "d.*")


def all_names(prefix: str = "") -> Column:
    names = [F.col(prefix + n) for n in ("canonical", "name_ru", "name_kk")]
    return F.array_distinct(F.concat(F.array(*names), F.col(prefix + "aliases")))


def _variants(rows: DataFrame, keys: list[str]) -> DataFrame:
    named = rows.select(*keys, F.explode(all_names()).alias("name"))
    normal = named.select(*keys, lt.normal("name").alias("name"))
    variants = normal.select(*keys, F.explode(lt.alias_variants(F.col("name"))).alias("alias"))
    return variants.where(F.col("alias") != "").distinct()


def city_aliases(catalog: DataFrame) -> DataFrame:
    """city, city_pos, alias (normal form, adjective stems included)."""
    rows = cities(catalog).withColumn("city", F.col("canonical"))
    return _variants(rows, ["city", "city_pos"])


def district_aliases(catalog: DataFrame) -> DataFrame:
    """city, city_pos, district, district_pos, alias."""
    rows = districts(catalog).withColumn("district", F.col("canonical"))
    return _variants(rows, ["city", "city_pos", "district", "district_pos"])


def integrity(catalog: DataFrame) -> DataFrame:
    """Problems of a catalog: duplicates, shared city aliases, blanks."""
    city = cities(catalog)

    def repeated(rows: DataFrame, column: str, label: str) -> DataFrame:
        return (
            rows.where(F.col(column).isNotNull() & (F.col(column) != ""))
            .groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
            .select(F.lit(label).alias("problem"), "value")
        )

    owners = (
        city.select("canonical", F.explode(all_names()).alias("name"))
        .select("canonical", lt.normal("name").alias("value"))
        .groupBy("value")
        .agg(F.count_distinct("canonical").alias("n"))
        .where(F.col("n") > 1)
        .select(F.lit("shared city alias").alias("problem"), "value")
    )
    blank = city.where(
        (F.coalesce("canonical", F.lit("")) == "")
        | (F.coalesce("name_ru", F.lit("")) == "")
        | (F.coalesce("name_kk", F.lit("")) == "")
    ).select(F.lit("blank city identity").alias("problem"), F.col("kato_code").alias("value"))
    return (
        repeated(city, "canonical", "duplicate city name")
        .unionByName(repeated(city, "kato_code", "duplicate city code"))
        .unionByName(repeated(city, "slug", "duplicate slug"))
        .unionByName(repeated(districts(catalog), "kato_code", "duplicate district code"))
        .unionByName(owners)
        .unionByName(blank)
    )


def unambiguous_aliases(catalog: DataFrame) -> DataFrame:
    """District aliases that name one canonical district in the whole catalog."""
    return (
        district_aliases(catalog)
        .groupBy("alias")
        .agg(F.count_distinct("district").alias("n"), F.min("district").alias("district"))
        .where(F.col("n") == 1)
        .select("alias", "district")
    )


def flat_district_aliases(catalog: DataFrame) -> DataFrame:
    """The unambiguous aliases that are not also a city's name."""
    tokens = cities(catalog).select(F.explode(all_names()).alias("name")).select(
        lt.normal("name").alias("alias")
    )
    return unambiguous_aliases(catalog).join(tokens, "alias", "left_anti")


def district_names(catalog: DataFrame) -> DataFrame:
    """Valid district names of a city as one text, in catalog order."""
    names = F.array_join(F.transform("districts", lambda d: d["name_ru"]), ", ")
    return catalog.select(F.col("canonical").alias("city"), F.coalesce(names, F.lit("")).alias("names"))
