"""Language-model scores by deleted interpolation.

A token's probability mixes three estimates: its share among the tokens that followed
the same word in training, its share among all training tokens, and a uniform one for what
was never seen:

    p(w | v) = a(v) c(v, w) / c(v)  +  b(v) c(w) / N  +  (1 - a(v) - b(v)) / (V + 1)

The weights depend on how frequent the context v is (one bucket per power of two).  They
are learned by expectation-maximisation on held-out counts: one part of the training texts is
deleted from all counts, its tokens are scored with what is left, and the weights are those that
make these tokens most likely.  The final estimates use all training texts again.

Every count covers the whole corpus; nothing is pruned or sampled.  How the work is dealt out:

1. Each task cuts its texts into blocks of some million tokens and stores them as numbers, with a
   64-bit hash of each distinct word.
2. Each block asks once for each of its distinct words and word pairs, with their training counts in
   the block.  Questions are dealt out by hash, so a word that is in every text is one number from
   each block, however often it occurs.  The task that has all questions of a hash range adds the
   counts up and answers every block, in the order of its questions.
3. A block meets its answers again and has the counts of all its tokens.

A pair of different words (or pairs) with the same 63-bit hash would share counts; among a
billion distinct ones some 0.05 are expected.

Nulls: a missing text is an empty one, whose only token is the end.  A missing id counts as empty text
in the split by crc32.  Without training texts all words are unknown and the uniform estimate
stands alone.  Repeated rows count as often as they occur and are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

FOLDS = 5
#: Remainder of crc32(doc_id) of the texts that nothing is learned from, and of those the weights are learned on.
TEST_FOLD, DELETED_FOLD = 1, 0
BLOCK_TOKENS = 800_000
#: Questions answered by one task, about.
RANGE_TOKENS = 1_200_000
END_HASH = 0x9E3779B97F4A7C15
#: Steps per octave in which the estimates of held-out tokens are counted, and EM steps.
STEPS, ITERATIONS = 4, 60
BUCKETS = 48
OCTAVES = 50


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def fold_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, text) as numbered words, a row per block."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() << 32
    seq = 0
    ids: list = []
    lengths: list[int] = []
    numbers: list[np.ndarray] = []
    at: dict[bytes, int] = {}

    def block() -> pa.RecordBatch:
        words = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
        # frequent words get small numbers, which pack well; 0 is the end of a text
        order = np.argsort(-np.bincount(words, minlength=len(at)), kind="stable")
        rank = np.empty(len(at), np.uint32)
        rank[order] = np.arange(1, len(at) + 1)
        listed = list(at)
        hashes = np.array([xxhash.xxh64_intdigest(listed[i]) for i in order.tolist()], np.uint64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part + seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([packed(rank[words])], pa.binary()), pa.array([packed(hashes)], pa.binary()),
            ],
            names=["block", "ids", "lengths", "words", "hashes"],
        )

    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words = (text or b"").lower().split()
            for w in set(words).difference(at):
                at[w] = len(at)
            numbers.append(np.fromiter(map(at.__getitem__, words), np.int32, len(words)))
            ids.append(doc_id)
            lengths.append(len(words))
            size += len(words) + 1
            if size >= BLOCK_TOKENS:
                yield block()
                seq, size = seq + 1, 0
                ids, lengths, numbers, at = [], [], [], {}
    if ids:
        yield block()


@dataclass
class Block:
    """A block's tokens: ``token`` and the ``before`` of each, as numbers, and the ``text`` it stands in."""

    ids: list
    fold: np.ndarray
    text: np.ndarray
    token: np.ndarray
    before: np.ndarray
    keys: np.ndarray
    pair: np.ndarray

    @classmethod
    def of(cls, ids: list, lengths: np.ndarray, words: bytes, hashes: bytes) -> Block:
        tokens = lengths + 1
        text = np.repeat(np.arange(len(ids)), tokens)
        last = np.cumsum(tokens) - 1
        token = np.zeros(tokens.sum(), np.int64)
        inside = np.ones(len(token), bool)
        inside[last] = False
        token[inside] = unpacked(words, np.uint32)
        # the end of the text before, or of none, is the context of a text's first token
        before = np.concatenate([[0], token[:-1]])
        word_hash = np.concatenate([[np.uint64(END_HASH)], unpacked(hashes, np.uint64)])
        pairs, pair = np.unique(before * len(word_hash) + token, return_inverse=True)
        with np.errstate(over="ignore"):
            one, two = word_hash[pairs // len(word_hash)], word_hash[pairs % len(word_hash)]
            mixed = (one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + two
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        # the lowest bit tells words from pairs
        keys = np.concatenate([word_hash | np.uint64(1), mixed & ~np.uint64(1)])
        return cls(ids, np.array([fold_of(i) for i in ids], np.int64), text, token, before, keys, pair + len(word_hash))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: how often it occurs in training texts, and in those deleted for the weights."""
        fold = self.fold[self.text]
        out = []
        for chosen in (fold != TEST_FOLD, fold == DELETED_FOLD):
            words = np.bincount(self.token[chosen], minlength=len(self.keys))
            out.append(words + np.bincount(self.pair[chosen], minlength=len(self.keys)))
        return out[0], out[1]

    def ranges(self, n: int) -> list[np.ndarray]:
        """For each of ``n`` hash ranges the positions of the keys in it, in the order of the keys."""
        order = np.argsort(self.keys)
        of = self.keys[order] // np.uint64((1 << 64) // n + 1)
        return np.split(order, np.searchsorted(of, np.arange(1, n, dtype=np.uint64)))


def _block_of(row: dict) -> Block:
    return Block.of(row["ids"], np.array(row["lengths"], np.int64), row["words"], row["hashes"])


def _questions(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block_of(row := batch.slice(i, 1).to_pylist()[0])
                all_, deleted = block.counts()
                for k, at in enumerate(block.ranges(n)):
                    if len(at):
                        keys = block.keys[at]
                        steps = np.concatenate([keys[:1], np.diff(keys)])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([k], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([packed(steps)], pa.binary()),
                                pa.array([packed(all_[at])], pa.binary()), pa.array([packed(deleted[at])], pa.binary()),
                            ],
                            names=["range", "block", "keys", "n", "n_deleted"],
                        )

    return run


ANSWER = "block long, range int, n binary, n_deleted binary, tokens long, words long, deleted_tokens long"


def _answer(questions: pa.Table) -> pa.Table:
    """Add the counts of each key of a hash range up, and answer every block."""
    rows = questions.to_pylist()
    keys = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    totals = []
    for name in ("n", "n_deleted"):
        counts = np.concatenate([unpacked(r[name], np.int64) for r in rows])
        totals.append(np.bincount(at, counts, len(distinct)).astype(np.int64))
    is_word = (distinct & np.uint64(1)).astype(bool)
    summary = [int(totals[0][is_word].sum()), int((totals[0][is_word] > 0).sum()), int(totals[1][is_word].sum())]
    pieces = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table({
        "block": pa.array([r["block"] for r in rows], pa.int64()),
        "range": pa.array([r["range"] for r in rows], pa.int32()),
        "n": pa.array([packed(totals[0][p]) for p in pieces], pa.binary()),
        "n_deleted": pa.array([packed(totals[1][p]) for p in pieces], pa.binary()),
        # what the whole range has stands in its first row
        **{
            name: pa.array([value] + [0] * (len(rows) - 1), pa.int64())
            for name, value in zip(("tokens", "words", "deleted_tokens"), summary)
        },
    })


@dataclass
class Totals:
    #: training tokens, distinct training tokens, training tokens that aren't deleted for the weights
    tokens: int
    words: int
    rest: int


def bucket_of(count: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0 for none, then one per power of two."""
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, BUCKETS - 1), 0)


def _step_of(share: np.ndarray) -> np.ndarray:
    """Steps below 1 of a share, 1 and up; 0 for nothing."""
    steps = np.rint(-np.log2(np.maximum(share, 1e-300)) * STEPS).astype(np.int64)
    return np.where(share > 0, np.minimum(steps, OCTAVES * STEPS) + 1, 0)


COUNTED = """doc_id long, held_out boolean, n_tokens long, n_known long, base_score double,
    seen array<long>, pairs array<long>, cells array<long>, weights array<long>"""


def _counted(n: int, totals: Totals):
    """Blocks with their answers -> a row per text with its tokens' counts, and a row per block with held-out evidence."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = _block_of(blocks.to_pylist()[0])
        counts, deleted = np.zeros(len(block.keys), np.int64), np.zeros(len(block.keys), np.int64)
        at = block.ranges(n)
        for r in answers.to_pylist():
            counts[at[r["range"]]] = unpacked(r["n"], np.int64)
            deleted[at[r["range"]]] = unpacked(r["n_deleted"], np.int64)
        seen, pairs = counts[block.token], counts[block.pair]
        texts = len(block.ids)
        base = np.log10((seen + 0.5) / (totals.tokens + 0.5 * (totals.words + 1)))
        held = np.flatnonzero(block.fold[block.text] == DELETED_FOLD)
        left = counts - deleted
        context = left[block.before[held]]
        one = left[block.token[held]] / max(totals.rest, 1)
        two = left[block.pair[held]] / np.maximum(context, 1)
        side = OCTAVES * STEPS + 2
        cells, weights = np.unique((bucket_of(context) * side + _step_of(one)) * side + _step_of(two), return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(block.text, minlength=texts))]).astype(np.int32)
        none = np.zeros(texts + 1, np.int32)
        listed = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))
        by_text = pa.table({
            "doc_id": pa.array(block.ids, pa.int64()),
            "held_out": pa.array(block.fold == TEST_FOLD),
            "n_tokens": pa.array(np.diff(offsets).astype(np.int64)),
            "n_known": pa.array(np.bincount(block.text, seen > 0, texts).astype(np.int64)),
            "base_score": pa.array(np.bincount(block.text, base, texts)),
            "seen": listed(offsets, seen), "pairs": listed(offsets, pairs),
            "cells": listed(none, []), "weights": listed(none, []),
        })
        nothing = listed(np.zeros(2, np.int32), [])
        evidence = pa.table({
            "doc_id": pa.nulls(1, pa.int64()), "held_out": pa.nulls(1, pa.bool_()), "n_tokens": pa.nulls(1, pa.int64()),
            "n_known": pa.nulls(1, pa.int64()), "base_score": pa.nulls(1, pa.float64()), "seen": nothing, "pairs": nothing,
            "cells": listed(np.array([0, len(cells)], np.int32), cells), "weights": listed(np.array([0, len(cells)], np.int32), weights),
        })
        return pa.concat_tables([by_text, evidence])

    return run


def learn_weights(cells: np.ndarray, weights: np.ndarray, words: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights (pair, word, uniform) per bucket, by expectation-maximisation on held-out tokens counted in cells."""
    side = OCTAVES * STEPS + 2
    bucket, one, two = cells // (side * side), cells // side % side, cells % side
    share = lambda step: np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0.0)
    p = np.column_stack([share(two), share(one), np.full(len(cells), 1 / (words + 1))])

    def learn(of: np.ndarray, start: np.ndarray, added: np.ndarray) -> np.ndarray:
        mix = start
        for _ in range(iterations):
            part = p[of] * mix
            part *= (weights[of] / part.sum(axis=1))[:, None]
            mix = part.sum(axis=0) + added
            mix = mix / mix.sum()
        return mix

    even = np.full(3, 1 / 3)
    # a few tokens' worth of the overall weights steadies buckets with little evidence
    overall = learn(np.arange(len(cells)), even, even)
    out = np.array([learn(np.flatnonzero(bucket == b), overall, 3 * overall) for b in range(BUCKETS)])
    out[0, 0] = 0  # an unseen context has no pairs
    out = np.maximum(out, [0, 1e-6, 1e-6])
    return out / out.sum(axis=1, keepdims=True)


def _scored(weights: np.ndarray, totals: Totals):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists = batch.column(batch.schema.get_field_index("seen"))
            seen = lists.flatten().to_numpy(zero_copy_only=False)
            pairs = batch.column(batch.schema.get_field_index("pairs")).flatten().to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            last = np.cumsum(lengths) - 1
            # a text's first token has the end as its context, and that is its last token
            context = np.concatenate([[0], seen[:-1]])
            context[last - lengths + 1] = seen[last]
            mix = weights[bucket_of(context)]
            p = mix[:, 0] * pairs / np.maximum(context, 1) + mix[:, 1] * seen / max(totals.tokens, 1) + mix[:, 2] / (totals.words + 1)
            score = np.bincount(np.repeat(np.arange(n), lengths), np.log10(p), n)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            base = batch.column(batch.schema.get_field_index("base_score"))
            train = pa.array(np.full(n, totals.tokens, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*columns, train, base, pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text): counts, ``base_score`` and the model's ``score`` (log10)."""
    spark = docs.sparkSession
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = keep(
        numbered.mapInArrow(_blocks, "block long, ids array<long>, lengths array<long>, words binary, hashes binary"), "lm_blocks"
    )
    size = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)), F.count("*")).first()
    n = max(2 * spark.sparkContext.defaultParallelism, -(-(size[0] or 0) // RANGE_TOKENS))
    questions = blocks.mapInArrow(_questions(n), "range int, block long, keys binary, n binary, n_deleted binary")
    answers = keep(questions.groupBy("range").applyInArrow(_answer, ANSWER), "lm_counts")
    tokens, words, deleted = answers.agg(F.sum("tokens"), F.sum("words"), F.sum("deleted_tokens")).first()
    totals = Totals(tokens or 0, words or 0, (tokens or 0) - (deleted or 0))
    answers = answers.select("block", "range", "n", "n_deleted")
    counted = keep(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_counted(n, totals), COUNTED), "lm_tokens")
    evidence = counted.where(F.size("cells") > 0).select(F.explode(F.arrays_zip("cells", "weights")).alias("c"))
    # at most BUCKETS * (OCTAVES * STEPS + 2)^2 cells, however large the corpus
    cells = evidence.groupBy("c.cells").agg(F.sum("c.weights").alias("weights")).orderBy("cells").toArrow()
    if not totals.tokens:
        weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    else:
        weights = learn_weights(cells.column("cells").to_numpy(), cells.column("weights").to_numpy().astype(float), totals.words)
    texts = counted.where("n_tokens IS NOT NULL").drop("cells", "weights")
    return texts.mapInArrow(
        _scored(weights, totals),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
