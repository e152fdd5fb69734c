"""Table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kb_stats(kb: DataFrame) -> DataFrame:
    """Rows, distinct cities and distinct provinces (nulls do not count)."""
    return kb.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("city").alias("n_cities"),
        F.countDistinct("province").alias("n_provinces"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequencies of the non-null values, most frequent first."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), column)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
