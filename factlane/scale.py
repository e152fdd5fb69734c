"""Helpers that keep plans sound on large and skewed inputs.

* ``durable`` writes a table once to the shared folder the cluster names and reads
  it back, so a lost executor costs a re-read, not a different answer.
* ``row_bytes`` measures what a decision to broadcast is based on.
* ``salted_lookup`` joins facts to a one-row-per-key table when one key, or the
  null key, may hold a large share of the facts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 500_000
SPREAD_BYTES = 1024 * 1024 * 1024
SHARED = "spark.checkpoint.dir"
SCRATCH = "factlane-scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables, which all machines share.

    It is set when the session is made (``local_session`` does so); a folder made
    up here would exist on one machine only.
    """
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError(f"set {SHARED} to a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{SCRATCH}/{name}-{uuid.uuid4().hex}"


_sent: list[Broadcast] = []


def shared(spark: SparkSession, value) -> Broadcast:
    """``value``, whose size the caller has checked, sent to all tasks until ``clear_scratch``."""
    _sent.append(spark.sparkContext.broadcast(value))
    return _sent[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables and what was sent around; for when the results that read them are written."""
    while _sent:
        _sent.pop().unpersist()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{SCRATCH}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, all_cores: bool = False) -> DataFrame:
    """The rows of ``df`` written once to the shared folder, columns and statistics kept.

    ``all_cores`` is for rows that much work follows: a small table in few files is
    dealt out to all cores.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return spread_small(written) if all_cores else written


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def fits(self, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> bool:
        return self.rows <= max_rows and self.bytes <= max_bytes


def row_bytes(df: DataFrame) -> Column:
    """About the bytes a row takes, over all its columns."""
    total = F.lit(32)
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + 16 + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + 16 + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            total = total + 8
    return total


def read_bytes(df: DataFrame) -> int:
    """About the bytes that ``df`` comes from.

    The estimate of a join is the product of its sides, far above what it gives for lookups, so the tables
    that are read count if they are less.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return min(read, int(plan.stats().sizeInBytes()))


def spread_small(df: DataFrame) -> DataFrame:
    """Uses all cores where a small input alone would not.

    A small table in one file is one task, however much work each row makes.  What
    comes from more than SPREAD_BYTES, whatever the cluster, is left as it lies.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if read_bytes(df) <= SPREAD_BYTES else df


def salted_lookup(facts: DataFrame, dim: DataFrame, on: str, spread: Column) -> DataFrame:
    """Left join of ``facts`` to ``dim``, which has one row per ``on``.

    Both sides reach the join straight from a shuffle, so Spark splits a key that
    holds much of the facts by itself, and sends ``dim`` around if it is small.  Facts
    without a key have no partner; they are dealt out by ``spread`` (any column that
    varies between them) instead of meeting in one task.
    """
    keyed = facts.withColumn("_alone", F.when(F.col(on).isNull(), F.xxhash64(spread)))
    values = [c for c in dim.columns if c != on]
    there = dim.select(F.col(on).alias("_key"), F.lit(None).cast("long").alias("_none"), *values)
    match = F.col(on).eqNullSafe(F.col("_key")) & F.col("_alone").eqNullSafe(F.col("_none"))
    return keyed.join(there, match, "left").drop("_key", "_none", "_alone")
