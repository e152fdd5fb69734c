"""Packing by optimal length buckets.

Sequences are padded to the upper bound of their length bucket.  Dynamic programming over the
global histogram of lengths chooses the bounds with the least padding overall; inside each
bucket, batches of as many sequences as the token budget allows are formed.

* The histogram has a cell per length, so bounds are optimal for lengths below 2^(PRECISION + 1) = 131 072 words.  Only
  longer ones share cells, of lengths within 0.0015 %, each with its count, the sum and the largest of its lengths: at most
  2^PRECISION cells per octave, whatever the input.  Padding is counted from true sums, and a bound is the
  largest true length of its last cell, so nothing is ever cut.
* Batches need a running number inside a bucket.  Rows are range-partitioned by bucket and a seeded hash and written;
  a partition knows how many rows of its bucket lie in the partitions before it.  A bucket with a third of all rows is
  many partitions.

Nulls: a missing text has length 0.  Sequences of length 0 are packed like others; if a bucket's bound is 0, its
batches take as many as of length 1.  A sequence longer than the budget is a batch of its own.  Equal ids and repeated rows
are separate sequences.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep
from .text import n_words

BUCKETS = 16
TOKEN_BUDGET = 16_384
PRECISION = 16
SEED = "pack-1"


def length_cell(length: Column) -> Column:
    """The length rounded up to PRECISION + 1 significant bits."""
    step = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - PRECISION).cast("int")
    unit = F.pow(F.lit(2.0), step).cast("long")
    return F.ceil(length / unit).cast("long") * unit


def best_bounds(largest: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over cells in the order of length, with the least padding.

    ``cost[k][j]``: least padding of the first j cells in k buckets.  The last bucket's best start
    never moves back as j grows, so each row is filled by halving, in n log n steps; all halves of one size at once.
    """
    n = len(largest)
    n_before = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    sum_before = np.concatenate([[0], np.cumsum(sums)]).astype(float)
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    starts = []
    for _ in range(min(buckets, n)):
        new, start = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        spans = np.array([[1, n, 0, n - 1]])
        while len(spans):
            first, last, low, high = spans.T
            j = (first + last) // 2
            sizes = np.minimum(high, j - 1) - low + 1
            begins = np.cumsum(sizes) - sizes
            i = np.repeat(low - begins, sizes) + np.arange(sizes.sum())
            at = np.repeat(j, sizes)
            padding = cost[i] + largest[at - 1] * (n_before[at] - n_before[i]) - (sum_before[at] - sum_before[i])
            new[j] = np.minimum.reduceat(padding, begins)
            start[j] = np.minimum.reduceat(np.where(padding == np.repeat(new[j], sizes), i, n), begins)
            halves = np.concatenate([np.column_stack([first, j - 1, low, start[j]]), np.column_stack([j + 1, last, start[j], high])])
            spans = halves[halves[:, 0] <= halves[:, 1]]
        starts.append(start)
        cost = new
    bounds, j = [], n
    for start in reversed(starts):
        if j > 0:
            bounds.append(int(largest[j - 1]))
            j = int(start[j])
    return bounds[::-1]


def bucket_bounds(lengths: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The best bounds for a table with a ``length`` column."""
    cells = lengths.groupBy(length_cell(F.col("length")).alias("cell")).agg(
        F.count("*").alias("n"), F.sum("length").alias("sum"), F.max("length").alias("largest")
    )
    # at most 2^PRECISION cells per octave of lengths
    table = cells.orderBy("cell").toPandas()
    if not len(table):
        return []
    return best_bounds(*[table[c].to_numpy(np.int64) for c in ("largest", "n", "sum")], buckets)


def pack(
    docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, seed: str = SEED
) -> DataFrame:
    """``docs`` with ``length``, ``bucket`` (its upper bound), ``batch`` and ``slot`` in it, and ``padding``.

    A batch's name is its bucket and number there; batch * bound is at most ``budget`` tokens.
    Columns of ``docs`` with these names are replaced.
    """
    length = n_words("text") if length is None else length
    added = {"length", "bucket", "batch", "slot", "padding"}
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]).alias("_own")
    hashed = F.xxhash64(F.lit(seed), *_hashable(docs)).alias("_h")
    # equal hashes, as of repeated ids, are told apart by where the row lies
    rows = keep(docs.select(own, length.cast("long").alias("length"), hashed, F.monotonically_increasing_id().alias("_row")), "lengths")
    bounds = bucket_bounds(rows, buckets)
    bound = F.lit(None).cast("long")
    for b in reversed(bounds):
        bound = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(bound)
    order = ["bucket", "_h", "_row"]
    sorted_ = rows.withColumn("bucket", bound).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = keep(
        sorted_.withColumn("_part", F.shiftright(at, 33)).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))).drop("_h", "_row"), "numbered"
    )
    runs = numbered.groupBy("bucket", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # rows lie in the order of buckets: at most a row per partition and bucket border
    placed = numbered.join(F.broadcast(keep(runs, "runs")), ["bucket", "_part"])
    number = F.col("_before") + F.col("_at") - F.col("_first")
    size = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))), F.lit(1))
    return placed.select(
        "_own.*", "length", "bucket",
        F.floor(number / size).cast("long").alias("batch"),
        F.pmod(number, size).cast("int").alias("slot"),
        (F.col("bucket") - F.col("length")).alias("padding"),
    )


def _hashable(docs: DataFrame) -> list[Column]:
    """The columns that a row's place is drawn from."""
    return [F.col("doc_id")] if "doc_id" in docs.columns else [F.col(f"`{c}`") for c in docs.columns]
