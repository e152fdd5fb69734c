"""For each asked text, the first row whose text contains it: one row per asked text.

A short text is in very many rows, so pairs of text and row are not made.  Rows are cut
into the pieces of the asked lengths inside their task, a Bloom filter of what is asked
keeps the others back, and the smallest ordinal of each piece is taken before and after
one shuffle.  What is left joins the asked texts by equality.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlane.operators.substrings import BITS_PER_VALUE, FILTER_BITS, PIECE_BITS, filter_bits, mixed
from factlane.scale import durable, shared, spread_small

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Windows:
    """Hashes of all windows of one text, for any length, from sums over its beginnings."""

    def __init__(self, text: str):
        letters = mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        powers = np.cumprod(np.r_[np.uint64(1), np.full(len(letters), BASE, np.uint64)], dtype=np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum(letters * powers[:-1], dtype=np.uint64)]
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(len(letters), INVERSE, np.uint64)], dtype=np.uint64)

    def of(self, length: int) -> np.ndarray:
        sums = self.sums[length:] - self.sums[:len(self.sums) - length]
        return mixed(mixed(sums * self.back[:len(sums)]) + np.uint64(length))


@F.arrow_udf(T.LongType())
def _whole_hash(texts: pa.Array) -> pa.Array:
    return pa.array([Windows(t).of(len(t)).view(np.int64)[0] for t in texts.to_pylist()], pa.int64())


def first_holders(rows: DataFrame, asked: DataFrame, value: str = "value", ordinal: str = "ord", wanted: str = "wanted") -> DataFrame:
    """(wanted, row): the smallest ``ordinal`` of the rows whose ``value`` contains the text.

    ``asked`` holds distinct texts; null and empty ones, and those in no row, give no row.
    The asked lengths come to the driver, a number each.  A full filter only lets more pieces through.
    """
    texts = durable(asked.where(F.length(wanted) > 0).select(wanted).withColumn("hash", _whole_hash(wanted)))
    facts = texts.agg(F.count("*").alias("n"), F.collect_set(F.length(wanted)).alias("lengths")).first()
    width = (min(FILTER_BITS, max(PIECE_BITS, BITS_PER_VALUE * facts["n"])) - 1).bit_length()
    sent = shared(rows.sparkSession, (sorted(facts["lengths"]), filter_bits(texts, width)))

    def pieces(values: pa.Array) -> pa.Array:
        lengths, bits = sent.value
        made = []
        for text in values.to_pylist():
            windows, found = Windows(text), set()
            for length in lengths:
                if length > len(text):
                    break
                at = windows.of(length) >> np.uint64(64 - width)
                may = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                found.update(text[i:i + length] for i in np.flatnonzero(may).tolist())
            made.append(list(found))
        return pa.array(made, pa.list_(pa.string()))

    there = spread_small(rows.where(F.length(value) > 0).select(F.col(ordinal).alias("row"), F.col(value).alias("_text")))
    # the outer form, since for the inner one the optimiser makes the array twice
    cut = there.select("row", F.explode_outer(F.arrow_udf(pieces, "array<string>")("_text")).alias(wanted))
    firsts = cut.where(F.col(wanted).isNotNull()).groupBy(wanted).agg(F.min("row").alias("row"))
    return firsts.join(texts.select(wanted), wanted).select(wanted, "row")
