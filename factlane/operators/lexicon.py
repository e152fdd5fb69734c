"""The entity dictionary of a knowledge base and entity recognition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlane.operators.substrings import SubstringIndex, build_substring_index, find_substrings

KINDS = ("name", "city", "province")


def first_seen(df: DataFrame, column: str, ordinal: str = "dataid") -> DataFrame:
    """(value, ord) of the distinct non-null values and where each appears first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.min(ordinal).alias("ord"))
    )


def entity_dictionary(kb: DataFrame, kinds=KINDS, ordinal: str = "dataid") -> DataFrame:
    """(kind, value, ord); ``ord`` orders the values of a kind as in the table."""
    tables = [first_seen(kb, kind, ordinal).select(F.lit(kind).alias("kind"), "value", "ord") for kind in kinds]
    return reduce(DataFrame.unionByName, tables)


def entity_index(kb: DataFrame, kinds=KINDS, ordinal: str = "dataid") -> SubstringIndex:
    """The dictionary prepared for matching; built once per knowledge base."""
    return build_substring_index(entity_dictionary(kb, kinds, ordinal))


def match_entities(questions: DataFrame, index: SubstringIndex, broadcast: bool | None = None) -> DataFrame:
    """(qid, kind, value, ord), one row per recognised entity."""
    return find_substrings(questions, index, broadcast=broadcast)


def _ordered(kind: str) -> Column:
    found = F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "value")))
    return F.array_sort(found)


def recognise(questions: DataFrame, index: SubstringIndex, kinds=KINDS) -> DataFrame:
    """Questions with ``names``, ``cities`` and ``provinces`` in table order,
    and ``first_name_ord``, the row the first recognised name points to.

    What is collected per question is bounded by the length of its own text.
    """
    grouped = (
        match_entities(questions, index)
        .where(F.col("kind").isin(*kinds))
        .groupBy("qid")
        .agg(*[_ordered(kind).alias(kind) for kind in KINDS])
    )
    empty = F.array().cast("array<string>")

    def values(kind: str) -> Column:
        return F.coalesce(F.transform(F.col(kind), lambda x: x["value"]), empty)

    return questions.join(grouped, "qid", "left").select(
        *questions.columns,
        values("name").alias("names"),
        values("city").alias("cities"),
        values("province").alias("provinces"),
        F.get(F.col("name"), F.lit(0))["ord"].alias("first_name_ord"),
    )
