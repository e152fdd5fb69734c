"""Words grouped with their spelling variants by a trie-node pair dictionary.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.  The
nodes of the trie of all words are numbered, and those of the trie of the reversed words.  A word of L
code points is then a path of L + 1 prefix nodes and one of L + 1 suffix nodes, and gives integer pairs
(prefix node, suffix node):

* position i skipped: the prefix before it and the suffix after it;
* position i inserted: the prefix and the suffix that meet there.

Words that share a pair with a skipped position differ at that position alone.  A word with a skipped
position that shares the pair of another's inserted position is that other one with a code point more.
These are all near words, and exactly them: a node number stands for one prefix or suffix.  A run of equal
code points is skipped at its first only, so no two words meet twice.  A pair is shared by at most one word per
code point of the alphabet with the position skipped, and one with it inserted, so groups are small however
many words there are.

Numbering needs no table of prefixes: words are range-partitioned and sorted, so a word shares its first
nodes with the word before it, as many as their common prefix has code points, and the others are new.
Where a partition begins, the nodes that its first word shares with the last word of the partition before are
put right from a table with a row per partition.

A word's form is its near word of the largest count (then the first in code-point order), if that count is at least
RATIO times its own; its root is where forms lead in the end.  Counts grow by RATIO with each step, so roots are
found by doubling steps, a few joins.

Nulls: a missing text has no words; a missing id counts as empty text in the hash.  Words of any length
take part, a very long one as its numbers only.  Repeated rows count as often as they occur.  Columns besides
``doc_id`` and ``text`` are not looked at.  Tables without words give no rows.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import keep

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
#: Of the hashes of id and word, those that this divides lose a code point; 0: none do.
MISSPELT = 97
#: Counted words that a task holds before it passes them on.
HELD_WORDS = 400_000
#: Node numbers: the partition above, the node in it below.
NODE_BITS = 36
#: Fixed: in Latin-1, ASCII capitals become small letters, letters from U+00C0 on stay, all else is a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters, ASCII ones small, in Latin-1: a byte a code point."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def counted(texts: Iterator[tuple[int | None, str | None]], misspelt: int = MISSPELT, min_length: int = MIN_LENGTH) -> Iterator[Counter]:
    """The words' counts, a counter at a time of about HELD_WORDS distinct ones."""
    total: Counter = Counter()
    crc = zlib.crc32
    for doc_id, text in texts:
        seen = Counter(runs(text or ""))
        if misspelt:
            start = crc(b":", crc(b"" if doc_id is None else str(doc_id).encode()))
            changed = []
            for run in seen:
                h = crc(run if run.isascii() else run.decode("latin-1").encode(), start)
                if h % misspelt == 0:
                    changed.append((run, h % len(run)))
            moved = [(run[:at] + run[at + 1 :], seen.pop(run)) for run, at in changed]
            for run, n in moved:
                seen[run] += n
        for run, n in seen.items():
            if len(run) >= min_length:
                total[run] += n
        if len(total) >= HELD_WORDS:
            yield total
            total = Counter()
    if total:
        yield total


def words(docs: DataFrame, misspelt: int = MISSPELT, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word``, ``n`` for all words of ``docs`` (doc_id, text) that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for total in counted(texts, misspelt, min_length):
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )

    light = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return light.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts in column 0 -> the same rows with the partition, the place in it, and the path of trie nodes."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    high = part << NODE_BITS
    before, path, nodes, at = "", [0], 0, 0
    for batch in batches:
        paths = []
        for text in batch.column(0).to_pylist():
            shared = len(os.path.commonprefix([before, text]))
            new = len(text) - shared
            path = path[: shared + 1] + list(range(high + nodes + 1, high + nodes + 1 + new))
            nodes += new
            before = text
            paths.append(path)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(high + at, high + at + n), pa.int64()),
                pa.array(paths, pa.list_(pa.int64())),
            ],
            names=[*batch.schema.names, "part", "place", "path"],
        )
        at += n


def trie_paths(texts: DataFrame, text: str) -> DataFrame:
    """``texts`` (distinct, not null) with ``place``, its rank with gaps, and ``path``: the nodes of its prefixes, from the root (0).

    A node's number is the same wherever its prefix occurs, and that of no other prefix.
    """
    spark = texts.sparkSession
    others = [c for c in texts.columns if c != text]
    ordered = texts.select(text, *others).repartitionByRange(text).sortWithinPartitions(text)
    schema = T.StructType([*ordered.schema, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    schema = schema.add("path", T.ArrayType(T.LongType()))
    local = keep(ordered.mapInArrow(_numbered, schema), "trie_paths")
    # two words a partition
    borders = local.groupBy("part").agg(F.min(text).alias("first"), F.max(text).alias("last"), F.max_by("path", "place").alias("path"))
    shared = []
    before, nodes = "", [0]
    for row in borders.orderBy("part").toLocalIterator():
        same = len(os.path.commonprefix([before, row["first"]]))
        right = nodes[1 : same + 1]
        shared.append((row["part"], right))
        # the path of the last word with the numbers put right
        low = row["part"] << NODE_BITS
        nodes = [right[x - low - 1] if 0 < x - low <= same else x for x in row["path"]]
        before = row["last"]
    table = spark.createDataFrame(shared, "part int, right array<long>")
    number = lambda x: x.bitwiseAND(F.lit((1 << NODE_BITS) - 1).cast("long"))
    right = F.transform(
        "path",
        lambda x: F.when((number(x) > 0) & (number(x) <= F.size("right")), F.get("right", (number(x) - 1).cast("int"))).otherwise(x),
    )
    # a row per partition
    return local.join(F.broadcast(table), "part").withColumn("path", right).drop("part", "right")


def _pairs(paths: DataFrame) -> DataFrame:
    """Rows (prefix, suffix, word's place, its count, ``skips``: a code point lies between, ``first``: of its run of equals).

    A word with position i skipped has prefix i and the suffix of the L - i - 1 last; with one inserted there, that of L - i.
    """
    skipped = F.transform(
        F.sequence(F.lit(0), F.col("size") - 1),
        lambda i: F.struct(
            F.get("prefixes", i).alias("prefix"), F.get("suffixes", F.col("size") - i - 1).alias("suffix"), F.lit(True).alias("skips"),
            ((i == 0) | (F.get("points", i) != F.get("points", i - 1))).alias("first"),
        ),
    )
    inserted = F.transform(
        F.sequence(F.lit(0), F.col("size")),
        lambda i: F.struct(
            F.get("prefixes", i).alias("prefix"), F.get("suffixes", F.col("size") - i).alias("suffix"), F.lit(False).alias("skips"),
            F.lit(True).alias("first"),
        ),
    )
    sized = paths.withColumn("size", F.size("prefixes") - 1).withColumn("points", F.split("word", ""))
    return sized.select("place", "n", F.explode(F.concat(skipped, inserted)).alias("p")).select("place", "n", "p.*")


def _best(members: Column) -> Column:
    """Of near words (n, place) the one with the largest count, then the smallest place."""
    return F.array_max(F.transform(members, lambda m: F.struct(m["n"].alias("n"), (-m["place"]).alias("back"))))


def neighbours(paths: DataFrame) -> DataFrame:
    """``place`` of each word that has near words, their number ``n_near``, and ``best``: (count, place) of the most frequent."""
    member = F.struct("place", "n", "skips", "first")
    groups = _pairs(paths).groupBy("prefix", "suffix").agg(F.collect_list(member).alias("g"))
    # at most a word per code point of the alphabet, and the one with the position inserted
    groups = groups.where(F.size("g") > 1)
    near = F.filter(
        "g",
        lambda m: (m["place"] != F.col("me.place"))
        # both skip, or one inserts and the other skips the first of a run
        & ((m["skips"] & F.col("me.skips")) | (m["skips"] & m["first"] & ~F.col("me.skips")) | (~m["skips"] & F.col("me.skips") & F.col("me.first"))),
    )
    found = groups.select(F.explode("g").alias("me"), "g").select(F.col("me.place").alias("place"), near.alias("near")).where(F.size("near") > 0)
    return found.groupBy("place").agg(F.sum(F.size("near")).alias("n_near"), F.max(_best(F.col("near"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``place``, ``root`` for rows (place, form): where forms lead in the end.

    Each round joins a place's target with that target's own, so the steps double.
    """
    state = keep(forms.select("place", F.col("form").alias("root")), "roots")
    while True:
        on = state.select(F.col("place").alias("root"), F.col("root").alias("next"))
        moved = state.join(on, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = keep(moved, "roots")
        if not moved.where("moved").head(1):
            return moved.drop("moved")
        state = moved.drop("moved")


def group_words(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """For ``counts`` (distinct ``word``, ``n``): word, form, root, n, n_near and form_n."""
    counts = counts.select("word", "n").where("word IS NOT NULL")
    prefixes = trie_paths(counts, "word").withColumnRenamed("path", "prefixes")
    suffixes = trie_paths(counts.select(F.reverse("word").alias("reversed")), "reversed")
    suffixes = suffixes.select(F.reverse("reversed").alias("word"), F.col("path").alias("suffixes"))
    paths = keep(prefixes.join(suffixes, "word"), "word_paths")
    near = keep(neighbours(paths), "near_words")
    listed = paths.select("place", "word", "n").join(near, "place", "left").select(
        "place", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.back")).alias("form"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best.n")).alias("form_n"),
    )
    listed = keep(listed, "word_forms")
    roots = _roots(listed.where("form IS NOT NULL"))
    name = listed.select("place", "word")
    formed = (
        listed.where("form IS NOT NULL").join(roots, "place")
        .join(name.select(F.col("place").alias("form"), F.col("word").alias("form_word")), "form")
        .join(name.select(F.col("place").alias("root"), F.col("word").alias("root_word")), "root")
        .select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")
    )
    alone = listed.where("form IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return formed.unionByName(alone)


def variants(
    docs: DataFrame, misspelt: int = MISSPELT, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO
) -> DataFrame:
    """A row per word of ``docs`` (doc_id, text), as ``group_words`` gives them."""
    return group_words(keep(words(docs, misspelt, min_length, min_count), "word_counts"), ratio)
