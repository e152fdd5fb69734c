"""Row-level relational operators: keep-first, dense ids, top-k, union, repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlane.scale import durable

ROW_BITS = 33


def keep_first(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row per key, the one that comes first.

    Spark limits each key to its first row inside every task before the shuffle,
    so a key with a third of all rows sends one row per task.  Null keys are equal.
    A hash in front of the keys lets rows be sorted by a number; long texts are
    compared only where it is equal.
    """
    order = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(ordinal)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def dense_ids(df: DataFrame, ordinal: str, id_column: str = "dataid") -> DataFrame:
    """Ids 1..n in the order of ``ordinal`` (unique), without one task seeing all rows.

    The rows are written first, as finding the ranges reads them once more than
    dealing them out.  Then they are range-partitioned and sorted, written so that
    their positions are final, and each partition's rows are shifted by what
    precedes it.
    """
    placed = durable(
        durable(df).repartitionByRange(ordinal).sortWithinPartitions(ordinal)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", ROW_BITS)
    placed = placed.withColumn("_part", part)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    # one row per partition of the range shuffle, so both this window and the
    # broadcast are bounded by the number of shuffle partitions
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    position = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    numbered = placed.join(F.broadcast(offsets), "_part")
    others = [c for c in df.columns if c != id_column]
    return numbered.select((F.col("_before") + position + 1).alias(id_column), *others)


def top_per_group(df: DataFrame, group: str, order, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; each task keeps ``k`` before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def top_rated(kb: DataFrame, k: int = 3) -> DataFrame:
    """The best-rated rows of each city, unrated last, ties in table order."""
    rating = F.nanvl(F.col("rating"), F.lit(None).cast("double"))
    return top_per_group(kb, "city", [rating.desc_nulls_last(), F.col("dataid")], k)


def head_rows(df: DataFrame, ordinal: str, n: int = 5) -> DataFrame:
    return df.orderBy(ordinal).limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Concatenation by column name; a column some inputs lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_columns_or_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly ``columns``, null where ``df`` has no such column."""
    return df.select(
        *[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    )


def literal_map(pairs: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def dim_lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """``df`` with the value of its key, ``default`` where there is none.

    ``dim`` has one row per key.  Which side is sent around is left to the size
    Spark knows of it.
    """
    return df.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def repair_values(df: DataFrame, mapping: DataFrame, within: str, column: str) -> DataFrame:
    """Replaces mapped values of ``column``, and only where ``within`` agrees too.

    ``mapping`` has ``within``, ``old_value`` and ``new_value``.  Adds ``repaired``.
    """
    on = (df[within] == mapping[within]) & (df[column] == mapping["old_value"])
    joined = df.join(mapping, on, "left")
    kept = [
        F.coalesce(mapping["new_value"], df[c]).alias(c) if c == column else df[c]
        for c in df.columns
    ]
    return joined.select(*kept, mapping["new_value"].isNotNull().alias("repaired"))


def count_repaired(repaired: DataFrame) -> DataFrame:
    return repaired.agg(F.count_if("repaired").alias("n_repaired"), F.count("*").alias("n_rows"))
