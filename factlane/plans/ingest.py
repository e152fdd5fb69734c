"""Raw rows to knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlane.constants import CITY_PROVINCE, RAW_COLUMNS, REPAIR_CITY, REPAIR_NAMES
from factlane.functions import clean
from factlane.operators.rows import dense_ids, dim_lookup, keep_first, repair_values, with_columns_or_null
from factlane.schemas import KB_COLUMNS
from factlane.sources.city_csv import read_city_files
from factlane.sources.tables import write_kb, write_kb_csv


def city_dimension(spark: SparkSession, mapping: dict[str, str] = CITY_PROVINCE) -> DataFrame:
    return spark.createDataFrame(list(mapping.items()), "city string, province string")


def repair_mapping(spark: SparkSession, city: str = REPAIR_CITY, names: dict[str, str] = REPAIR_NAMES) -> DataFrame:
    return spark.createDataFrame([(city, a, b) for a, b in names.items()], "city string, old_value string, new_value string")


def clean_rows(raw: DataFrame) -> DataFrame:
    """Every cleaning rule in one projection; rows without a name are dropped."""
    rows = with_columns_or_null(raw, [*RAW_COLUMNS, "city", "ord"])
    cell = F.col
    return rows.select(
        "ord",
        clean.clean_name(cell("名字")).alias("name"),
        "city",
        clean.extract_address(cell("地址")).alias("address"),
        clean.extract_phone(cell("地址")).alias("phone"),
        clean.extract_website(cell("地址")).alias("website"),
        clean.clean_rating(cell("评分")).alias("rating"),
        clean.price_floor(cell("门票")).alias("ticket_price"),
        clean.clean_open_time(cell("开放时间")).alias("open_time"),
        clean.clean_suggest_time(cell("建议游玩时间")).alias("suggest_time"),
        clean.extract_tags(cell("名字"), cell("介绍")).alias("tags"),
        clean.truncate_text(cell("介绍")).alias("description"),
        clean.clean_text(cell("小贴士")).alias("tips"),
    ).where(F.col("name") != "")


def build_kb(raw: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """The 14-column knowledge base of raw rows (raw columns, ``city``, ``ord``).

    One shuffle to keep the first of equal (name, city), one to number the rows.
    """
    dimension = dimension if dimension is not None else city_dimension(raw.sparkSession)
    first = keep_first(clean_rows(raw), ["name", "city"], "ord")
    placed = dim_lookup(first, dimension, "city", "province")
    return dense_ids(placed, "ord").select(*KB_COLUMNS)


def repair_kb(kb: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """The knowledge base with repaired names, and a flag ``repaired``."""
    mapping = mapping if mapping is not None else repair_mapping(kb.sparkSession)
    return repair_values(kb, mapping, "city", "name")


def ingest(spark: SparkSession, folder: str, cities: dict[str, str], target: str, csv_target: str | None = None) -> dict:
    """The whole job: read, clean, merge, write.  Returns what it wrote."""
    raw = read_city_files(spark, folder, cities)
    if raw.isEmpty():
        return {"rows": 0, "per_city": {}, "written": False}
    write_kb(build_kb(raw), target)
    stored = spark.read.parquet(target)
    if csv_target:
        write_kb_csv(stored, csv_target)
    per_city = {r["city"]: r["n"] for r in stored.groupBy("city").agg(F.count("*").alias("n")).collect()}
    return {"rows": sum(per_city.values()), "per_city": per_city, "written": True}
