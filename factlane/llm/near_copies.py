"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes
of all its word shingles.  Two texts are linked if their fingerprints differ in
``max_bits`` bits or fewer; a component is what links reach.

The fingerprint is cut into segments.  If two of them differ in at most
``max_bits`` bits, then in one segment they differ in at most
``max_bits // segments``: each fingerprint stands in one table per segment under
that segment's value, looks up all values of the small Hamming ball around it
there, and keeps what lies within ``max_bits`` over all 64 bits.

* Equal fingerprints are one row from the start, with their smallest id, however
  many texts share them.
* Table entries are blocks of bounded length, so a segment value shared by many
  fingerprints is many rows, and the lookup is an equi-join that Spark can split.
* Verified links never leave a task as pairs: each batch passes on a spanning
  forest, which has the same components.
* Components come from alternating large and small stars, each step written out.

Nulls: a missing text is an empty one and has fingerprint zero, linked like any
other.  Missing ids take part; a component's id is the smallest id that is there,
null if there is none.  Repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep
from .text import per_text

SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENTS = 2
HASH_SEED = 42
#: Fingerprints in one table entry, and shingles whose bits are counted at once.
BLOCK = 1024
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """The SimHash of a text: ASCII letters lower-cased, repeated shingles counted each time."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        first = starts[at : min(n, at + CHUNK)].tolist()
        last = ends[at + shingle_words - 1 : at + shingle_words - 1 + len(first)].tolist()
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (the 64 bits as a long) in place of the text."""

    def function(texts: list[bytes]) -> list[list]:
        values = np.array([fingerprint(t, shingle_words) for t in texts], dtype=np.uint64)
        return [values.view(np.int64)]

    return per_text(docs, text, "fingerprint long", function)


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what ``a``-``b`` connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (fingerprint, its neighbours) to the edges of a spanning forest of the batch."""
    for batch in batches:
        near = batch.column(1)
        counts = near.value_lengths().to_numpy(zero_copy_only=False)
        u = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
        hi, lo = spanning_forest(u, near.flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])


def segment_masks(max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> list[tuple[int, int, list[int]]]:
    """For each segment: its shift, its mask, and the differences of its Hamming ball."""
    edges = [64 * i // segments for i in range(segments + 1)]
    out = []
    for low, high in zip(edges, edges[1:]):
        ball = [sum(1 << bit for bit in bits) for r in range(max_bits // segments + 1) for bits in combinations(range(high - low), r)]
        out.append((low, (1 << (high - low)) - 1, ball))
    return out


def _shifted(differences: Column, value: Column, tag: Column) -> Column:
    return F.transform(differences, lambda d: tag + value.bitwiseXOR(d))


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """Edges (hi, lo) whose components are those of all pairs within ``max_bits``.

    ``distinct`` has each ``fingerprint`` once.  Segments must have fewer than 58 bits.
    """
    fp = F.col("fingerprint")
    entry, probe = [], []
    for i, (shift, mask, ball) in enumerate(segment_masks(max_bits, segments)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(mask).cast("long"))
        tag = F.lit(i).cast("long") * F.lit(1 << 58)
        entry.append(tag + value)
        differences = F.array(*[F.lit(d).cast("long") for d in ball])
        probe.append(_shifted(differences, value, tag))
    entries = distinct.select("fingerprint", F.explode(F.array(*entry)).alias("value"))
    # a value that many fingerprints share takes several table entries
    crowded = entries.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    crowded = keep(crowded, "crowded")
    table = (
        entries.join(crowded, "value", "left")
        .withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1))))
        .groupBy("value", "block")
        .agg(F.collect_list("fingerprint").alias("entry"))
        .select("value", "entry")
    )
    table = keep(table, "segment_table")
    probes = distinct.select("fingerprint", F.explode(F.concat(*probe)).alias("value"))
    near = F.filter(
        "entry",
        lambda x: (x < F.col("fingerprint")) & (F.bit_count(x.bitwiseXOR(F.col("fingerprint"))) <= max_bits),
    )
    # probes are many times what Spark takes them for, so they must not be sent around
    found = probes.hint("merge").join(table, "value").select("fingerprint", near.alias("near")).where(F.size("near") > 0)
    return found.mapInArrow(_forests, "hi long, lo long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (hi, lo) but the roots themselves.

    The root is the component's smallest node.  Alternates large stars (each node
    ties its larger neighbours to its smallest) and small stars (each node ties
    its smaller neighbours to the smallest) until nothing changes.
    """

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = keep(edges.distinct(), "edges")
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        low = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large_star")
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        large = keep(large, "large_edges")
        low = keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "small_star")
        small = (
            large.join(low, "hi")
            .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
            .distinct()
        )
        edges = keep(small, "edges")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _named(light: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """For each ``fingerprint`` of ``light`` its ``root`` (a fingerprint) and ``component_id``."""
    distinct = keep(light.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct, max_bits, segments))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = keep(rooted, "rooted")
    smallest = keep(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    return keep(rooted.join(smallest, "root").select("fingerprint", "root", "component_id"), "named")


def near_copies(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` as 16 hex digits, ``component_id``."""
    light = keep(fingerprints(docs.select("doc_id", "text"), shingle_words), "fingerprints")
    named = _named(light, max_bits, segments)
    return light.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, segments: int = SEGMENTS
) -> DataFrame:
    """The documents with one of each component left: that with the smallest id.

    If several rows have that id, or none of the component's rows has one, one of
    them stays.
    """
    light = keep(fingerprints(docs.select("doc_id", "text"), shingle_words), "fingerprints")
    named = _named(light, max_bits, segments)
    times = light.groupBy("doc_id").agg(F.count("*").alias("times"), F.min("fingerprint").alias("fingerprint"))
    times = keep(times, "ids")
    stay = times.where("times = 1").join(named, "fingerprint").where("doc_id = component_id")
    stay = keep(stay.select(F.col("doc_id").alias("_stays")), "staying")
    kept = docs.join(stay, docs["doc_id"] == stay["_stays"]).select(*[docs[f"`{c}`"] for c in docs.columns])
    shared = times.where("times > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_shared"))
    if not shared.head(1):
        return kept
    own = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc")
    rows = docs.join(shared, docs["doc_id"].eqNullSafe(shared["_shared"])).select(own, docs["doc_id"], docs["text"])
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "shared_ids")
    of_row = fingerprints(rows.select("_row", "doc_id", "text"), shingle_words).join(named, "fingerprint")
    first = of_row.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("_row").alias("_row"))
    return kept.union(rows.join(first.select("_row"), "_row").select("_doc.*"))
