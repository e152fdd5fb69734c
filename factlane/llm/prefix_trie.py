"""The prefix trie of conversations by van Emde Boas recursion.

A conversation is a sequence of turns; a node of depth d is a distinct sequence of d first turns.
The recursion cuts sequences of height 2^k at half depth: what lies above the cut is a trie of half the
height, what lies below is a forest of tries of half the height, one under each distinct cut prefix.  Both
halves are built alike, and all tries of one height in one job, so there are as many rounds as the longest
conversation has binary digits.

1. Names of pieces, from the bottom: a turn's name is a digest of role and text, that of an aligned piece of 2^k
   turns the digest of its halves' names.
2. Names of cut prefixes, from the top: the root is known; in round k each known node at a multiple of 2^(k+1) and the
   piece of 2^k turns after it name the node at the cut.  Names are 128 bits of SHA-256, so equal prefixes have
   equal names without meeting anywhere, however many conversations share them.
3. Totals, grafted upward: at height 1 a node's subtree is the node.  In round k the total of each node on a cut
   is added to its 2^k ancestors in the upper trie, read from the path of its smallest member.

Every table is in long form, a row per conversation and depth, and each round reads at most as many rows as there
are turns; no conversation is ever one row or one group.  Turns get their positions from range partitions, as
one conversation may be longer than a partition.

``ends_sha256`` hashes a list of ids that may be a third of all.  Ids are range-partitioned and put into pieces of
bounded length, and only the pieces of a node go through one hash, one after the other.

Nulls: missing roles and texts are empty.  Turns are ordered by number, missing ones first; turns with equal
numbers by role and then by the digest of role and text, so repeated rows are turns of their own.  Rows without
``conv_id`` are one conversation, which counts as member; its id is missing in smallest ids and digests.  A table without
rows has no nodes.  Columns besides the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep
from .text import n_words

NO_IDS = hashlib.sha256(b"").hexdigest()
#: Ids in one piece of the list that is hashed.
PIECE_IDS = 50_000


def named(*parts: Column) -> Column:
    """128 bits of SHA-256 of the parts one after the other."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def turn_name(role: Column, text: Column) -> Column:
    """The name of a turn; the length of the role keeps it apart from the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return named(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def positioned(turns: DataFrame) -> DataFrame:
    """``c`` (the id as text, empty if missing), ``conv_id``, ``pos`` (from 0), ``name`` and ``words`` of each turn."""
    light = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"),
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        turn_name(F.col("role").cast("string"), F.col("text").cast("string")).alias("name"), n_words(F.col("text").cast("string")).alias("words"),
    )
    order = ["conv_id", "turn", "role", "name"]
    at = F.monotonically_increasing_id()
    sorted_ = light.repartitionByRange(*order).sortWithinPartitions(*order).drop("role", "turn")
    sorted_ = keep(sorted_.withColumn("part", F.shiftright(at, 33)).withColumn("at", at.bitwiseAND(F.lit((1 << 33) - 1))), "turns")
    # a conversation is in several partitions if it is long; those before a partition have some of its turns
    stretches = sorted_.groupBy("c", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pos = (F.col("before") + F.col("at") - F.col("first")).alias("pos")
    return sorted_.join(stretches, ["c", "part"]).select("c", "conv_id", pos, "name", "words")


def shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations (as ``positioned`` gives them) whose first turns are those of another.

    Conversation c begins with the first h turns of conversation c - c % ``every`` (fewer if it has fewer), then come
    its own after its first h; h is crc32 of c as text modulo ``most``.  Gives a row per turn, and
    one of position null for each conversation.  A conversation without id keeps its own turns.
    """
    h = F.when(F.col("conv_id").isNull(), 0).otherwise(F.pmod(F.crc32(F.col("c").cast("binary")), F.lit(most))).cast("long")
    base = F.coalesce((F.col("conv_id") - F.col("conv_id") % every).cast("string"), F.lit(""))
    lengths = turns.groupBy("c", "conv_id").agg(F.count("*").alias("n"))
    convs = keep(lengths.select("c", "conv_id", "n", h.alias("h"), base.alias("base")), "conversations")
    base_lengths = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    # how many turns the base gives
    convs = convs.join(base_lengths, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = keep(convs.drop("n", "base_n"), "conversations")
    heads = turns.where(F.col("pos") < most - 1).select(F.col("c").alias("base"), "pos", "name", "words")
    taken = convs.where("given > 0").join(heads, "base").where("pos < given").select("c", "conv_id", "pos", "name", "words")
    own = turns.join(convs.select("c", "h", "given"), "c").where("pos >= h")
    own = own.select("c", "conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "name", "words")
    none = convs.select("c", "conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("name"), F.lit(0).cast("long").alias("words"))
    return taken.unionByName(own).unionByName(none)


def node_paths(turns: DataFrame) -> tuple[DataFrame, int]:
    """The node at each depth of each conversation: ``c``, ``conv_id``, ``depth``, ``node``, ``words`` of its last turn, ``last``; and the largest depth.

    ``turns``: ``c``, ``conv_id``, ``pos``, ``name``, ``words``, and a row of ``pos`` null for each conversation.
    """
    real = turns.where("pos IS NOT NULL")
    deepest = real.agg(F.max("pos")).first()[0]
    height = 0 if deepest is None else int(deepest + 1)
    rounds = (height - 1).bit_length() if height else 0
    pieces = [real.select("c", "pos", "name")]
    for _ in range(rounds):
        # whole pieces only: a cut has nothing to name where the sequence ends before it
        half = F.col("pos").bitwiseAND(F.lit(1).cast("long"))
        pair = pieces[-1].groupBy("c", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("upper"), F.max(F.when(half == 1, F.col("name"))).alias("lower")
        )
        pair = pair.where("upper IS NOT NULL AND lower IS NOT NULL").select("c", "pos", named(F.col("upper"), F.col("lower")).alias("name"))
        pieces.append(keep(pair, "pieces"))
    known = turns.where("pos IS NULL").select("c", F.lit(0).cast("long").alias("depth"), named(F.lit(b"")).alias("node"))
    for k in reversed(range(rounds + 1)):
        upper = pieces[k].where(F.col("pos").bitwiseAND(F.lit(1).cast("long")) == 0)
        after = upper.select("c", F.shiftleft("pos", k).alias("depth"), F.col("name").alias("piece"))
        cut = known.join(after, ["c", "depth"]).select(
            "c", (F.col("depth") + (1 << k)).alias("depth"), named(F.col("node"), F.col("piece")).alias("node")
        )
        known = keep(known.unionByName(cut), "nodes")
    ends = turns.groupBy("c", "conv_id").agg(F.count("pos").alias("n"))
    words = real.select("c", (F.col("pos") + 1).alias("depth"), "words")
    out = known.join(words, ["c", "depth"], "left").join(ends, "c")
    return keep(
        out.select("c", "conv_id", "depth", "node", F.coalesce("words", F.lit(0)).alias("words"), (F.col("depth") == F.col("n")).alias("last")),
        "trie_paths",
    ), height


def graft(nodes: DataFrame, paths: DataFrame, height: int, values: list[str]) -> DataFrame:
    """``nodes`` (``node``, ``member``, ``depth``) with each of ``values`` summed over the node's subtree.

    ``member`` is a conversation through the node, as in ``paths`` (``c``, ``depth``, ``node``).
    """
    totals = nodes
    for k in range(height.bit_length()):
        # nodes on a cut: the first ones of a lower trie
        cut = totals.where(F.shiftright("depth", k).bitwiseAND(F.lit(1).cast("long")) == 1).where(
            F.col("depth").bitwiseAND(F.lit((1 << k) - 1).cast("long")) == 0
        )
        cut = cut.select(F.col("member").alias("c"), (F.shiftright("depth", k) - 1).alias("piece"), *values)
        above = paths.select("c", F.shiftright("depth", k).alias("piece"), "node")
        sums = above.join(cut, ["c", "piece"]).groupBy("node").agg(*[F.sum(v).alias(f"below_{v}") for v in values])
        added = [(F.col(v) + F.coalesce(f"below_{v}", F.lit(0))).alias(v) for v in values]
        others = [c for c in nodes.columns if c not in values]
        totals = keep(totals.join(sums, "node", "left").select(*others, *added), "totals")
    return totals


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, conv_id) -> pieces of a node's list: the first id, the ids joined by commas."""
    node, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())],
            names=["node", "first", "ids"],
        )

    for batch in batches:
        for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (n != node or len(ids) >= PIECE_IDS):
                yield piece()
                ids = []
            node = n
            ids.append(i)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> the digest of each node's list."""
    node, digest = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if digest is not None and n == node:
                digest.update(b",")
            else:
                if digest is not None:
                    yield done()
                node, digest = n, hashlib.sha256()
            digest.update(ids.encode())
    if digest is not None:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """For rows (``node``, ``conv_id``) the SHA-256 of each node's ids, ascending and joined by commas."""
    ids = ends.where("conv_id IS NOT NULL").select("node", "conv_id")
    pieces = ids.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first long, ids string")
    pieces = keep(pieces, "id_pieces")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row per node of the trie of ``turns`` (as ``shared_heads`` gives them).

    ``conv_id``: the smallest member; ``depth``; ``parent_conv_id``; ``n_convs``: members; ``n_children``; ``n_leaves``: childless
    nodes of the subtree; ``saved_tokens``: words that one copy of each turn saves in the subtree; ``ends_sha256``.
    """
    turns = keep(turns, "rebuilt")
    paths, height = node_paths(turns)
    nodes = paths.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.count("*").alias("n_convs"), F.first("words").alias("words")
    )
    nodes = keep(nodes.withColumn("member", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), "trie_nodes")
    above = paths.select(F.col("c").alias("member"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    linked = nodes.join(above, ["member", "depth"], "left")
    children = linked.groupBy("parent").agg(F.count("*").alias("n_children")).where("parent IS NOT NULL")
    own = linked.join(children.withColumnRenamed("parent", "node"), "node", "left").select(
        "node", "member", "conv_id", "depth", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = graft(keep(own, "trie_values"), paths.select("c", "depth", "node"), height, ["n_leaves", "saved_tokens"])
    digests = end_digests(paths.where("last"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return totals.join(parents, "parent", "left").join(digests, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text), rebuilt with shared first turns."""
    return trie(shared_heads(keep(positioned(conversations), "positioned"), every, most))
