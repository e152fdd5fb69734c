"""Exact substring join: which dictionary values occur in which texts.

A join on ``contains`` has no key, so it compares every text with every value.
Here each value gets one *anchor*, a piece of 1, 2, 4, 8 or 16 characters of it
chosen to be rare among the values, and texts are joined on hashes of their pieces of
those lengths.  A text that holds a value holds its anchor, so nothing is lost,
and ``contains`` on the candidates removes what is too much.  Every pair comes
out once, since a value has one anchor and a text's hashes are made distinct.

A Bloom filter of the anchors, of FILTER_BITS at most whatever the dictionary, goes to all tasks.  Each text's
pieces are hashed and filtered inside its row, so only hashes that may be some anchor's leave it; what
the filter lets through by mistake finds no anchor or fails ``contains``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlane.functions.terms import grams
from factlane.scale import Size, durable, row_bytes, shared, spread_small

ANCHOR_LENGTHS = (16, 8, 4, 2, 1)
#: The filter has about BITS_PER_VALUE bits for each value, and at most FILTER_BITS (16 MB); a piece of it is a bitmap of Spark's.
BITS_PER_VALUE, FILTER_BITS, PIECE_BITS = 16, 1 << 27, 32768


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def piece_hashes(text: str, lengths: tuple[int, ...]) -> np.ndarray:
    """Hashes of all pieces of the text that have one of ``lengths``, powers of two; a length's hashes come from those of half of it."""
    hashes = mixed(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
    found, size = [], 1
    while len(hashes) and size <= max(lengths):
        if size in lengths:
            found.append(hashes)
        hashes = mixed(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])
        size *= 2
    return np.concatenate(found) if found else np.empty(0, np.uint64)


@F.arrow_udf(T.LongType())
def _whole_hash(pieces: pa.Array) -> pa.Array:
    """The hash of a piece that has one of the lengths."""
    return pa.array([piece_hashes(p, (len(p),)).view(np.int64)[0] for p in pieces.to_pylist()], pa.int64())


@dataclass(frozen=True)
class SubstringIndex:
    """A dictionary ready to be searched for in texts.

    ``entries`` has ``value``, ``anchor``, its ``hash``, and the dictionary's other columns.  ``bits``: the
    filter, a bit for each first ``width`` bits of a hash.
    """

    entries: DataFrame
    lengths: tuple[int, ...]
    size: Size
    width: int
    bits: np.ndarray


def anchor_length(value):
    chosen = None
    for n in ANCHOR_LENGTHS:
        fits = F.length(value) >= n
        chosen = F.when(fits, F.lit(n)) if chosen is None else chosen.when(fits, F.lit(n))
    return chosen


def build_substring_index(dictionary: DataFrame, value: str = "value") -> SubstringIndex:
    """Chooses anchors and writes the entries once.

    Null and empty values are left out.  Only the dictionary is shuffled, and
    only per piece, so a prefix that all values share makes no hot anchor: the
    rarest piece of each value wins.
    """
    entries = dictionary.where(F.col(value).isNotNull() & (F.col(value) != "")).withColumnRenamed(value, "value")
    values = entries.select("value").distinct()
    pieces = values.select(
        "value",
        F.explode(F.array_distinct(grams(F.col("value"), anchor_length(F.col("value"))))).alias("piece"),
    )
    frequency = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    anchors = (
        pieces.join(frequency, "piece")
        .groupBy("value")
        .agg(F.min(F.struct("n", "piece")).alias("rarest"))
        .select("value", F.col("rarest.piece").alias("anchor"))
    )
    written = durable(entries.join(anchors.withColumn("hash", _whole_hash("anchor")), "value"))
    facts = written.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row_bytes(written)), F.lit(0)).alias("bytes"),
        F.collect_set(F.length("anchor")).alias("lengths"),
    ).first()
    wanted = min(FILTER_BITS, max(PIECE_BITS, BITS_PER_VALUE * facts["rows"]))
    width = (wanted - 1).bit_length()
    return SubstringIndex(written, tuple(sorted(facts["lengths"])), Size(facts["rows"], facts["bytes"]), width, filter_bits(written, width))


def filter_bits(entries: DataFrame, width: int) -> np.ndarray:
    """The filter's bytes; its pieces are made where the entries lie, and are FILTER_BITS together at most."""
    at = F.shiftrightunsigned("hash", 64 - width) + 1
    pieces = entries.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((1 << width) // 8, np.uint8)
    for row in pieces.collect():
        first = (row["piece"] - 1) * PIECE_BITS // 8
        out[first:first + PIECE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def _surviving(spark: SparkSession, index: SubstringIndex, filtered: bool):
    """A function of a text: the distinct hashes of its pieces that the filter lets through."""
    sent, width, lengths = shared(spark, index.bits if filtered else None), index.width, index.lengths

    def hashes(texts: pa.Array) -> pa.Array:
        bits, kept, ends = sent.value, [], [0]
        for text in texts.to_pylist():
            found = piece_hashes(text or "", lengths)
            if bits is not None:
                at = found >> np.uint64(64 - width)
                found = found[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            kept.append(np.unique(found))
            ends.append(ends[-1] + len(kept[-1]))
        flat = np.concatenate(kept) if kept else np.empty(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))

    return F.arrow_udf(hashes, "array<bigint>")


def find_substrings(
    texts: DataFrame,
    index: SubstringIndex,
    key: str = "qid",
    text: str = "text",
    broadcast: bool | None = None,
    filtered: bool = True,
) -> DataFrame:
    """(key, every column of the dictionary) for each row of ``texts`` and value that occurs in it.

    Null and repeated keys are rows like others.  A dictionary whose measured size, all columns counted,
    fits is sent to all tasks; the texts are then not shuffled at all.  For a larger one the texts are numbered
    and written, (row, hash) is shuffled to the anchors, and the candidates go back to the rows, where a
    text arrives once, however many candidates it has; an anchor that most texts hold is split by Spark.
    Either way, and without the filter, the rows are the same.
    """
    entries = index.entries
    payload = [c for c in entries.columns if c not in ("anchor", "hash")]
    if not index.lengths:
        return texts.select(key).where(F.lit(False)).join(entries.select(*payload), F.lit(False), "inner")
    if broadcast is None:
        broadcast = index.size.fits()
    surviving = _surviving(texts.sparkSession, index, filtered)
    known = entries.select("hash", *payload)
    there = spread_small(texts.where(F.col(text).isNotNull())).select(F.col(key), F.col(text).alias("_text"))
    holds = F.col("_text").contains(F.col("value"))
    # the outer form, since for the inner one the optimiser tests the array for being empty and so makes it twice
    if broadcast:
        pieces = there.withColumn("_hashes", surviving("_text")).select(key, "_text", F.explode_outer("_hashes").alias("hash"))
        return pieces.join(F.broadcast(known), "hash").where(holds).select(key, *payload)
    rows = durable(there.withColumn("_row", F.monotonically_increasing_id()))
    pieces = rows.select("_row", surviving("_text").alias("_hashes")).select("_row", F.explode_outer("_hashes").alias("hash"))
    candidates = pieces.where("hash IS NOT NULL").hint("merge").join(known, "hash").drop("hash")
    return rows.hint("merge").join(candidates, "_row").where(holds).select(key, *payload)
