"""Passages that repeat, removed by super-k-mer partitioning.

A window is WINDOW consecutive words of one text.  A word goes if any window over it has the same
words as a window that starts elsewhere, in the same text or another; all windows are judged on the
input.

A window's minimiser is the smallest hash among its MINIMISER_WORDS-word pieces.  Consecutive windows
with one minimiser are a super-k-mer and travel as one packed string, some three words for each word of
the input instead of WINDOW.  Equal windows have equal minimisers, so they meet in the bucket that the minimiser
is dealt to, where sorting counts them.

1. Each task cuts its texts into blocks of some hundred thousand words and writes them with their
   super-k-mers' minimisers.
2. Each block sends each distinct super-k-mer once, with whether it occurs more than once there, so a
   passage that is in every text is one string a block.
3. A bucket sorts the windows of its strings by hash, compares the words of neighbours with equal
   hashes, and answers every block with one bit a window.
4. A block meets its answers and marks the words that repeated windows cover.

A passage that very many texts share gives as many different strings with the same minimisers, where
it borders on other words.  A bucket that this makes too large is not sent as strings: its windows are
sent one by one as digests of 128 bits, dealt out by digest, so no minimiser's windows are ever one task.  (With
10^14 such windows, two different ones have equal digests with probability 10^-10.)  The list of those
buckets is at most MAX_HEAVY numbers, as each has more than 1 / MAX_HEAVY of all words.

Nulls: a missing text has no words.  Missing and repeated ids are rows like others, and a repeated row's
windows occur as often as the row.  A text shorter than the window is kept whole.  A very long text is a
block of its own.  Columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .interpolated_lm import packed, unpacked
from .store import keep

WINDOW = 35
MINIMISER_WORDS = 4
BLOCK_WORDS = 500_000
#: Words that a bucket's strings have together, about, and how many times as many are too large.
RANGE_WORDS, TOO_LARGE = 2_000_000, 3
MAX_HEAVY = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` of ``words`` (hashes), from hashes of runs half as long."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    doubled, size = words, 1
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out = doubled
            else:
                n = len(words) - done - size + 1
                out = mixed(out[:n] * np.uint64(0x9E3779B97F4A7C15) + doubled[done : done + n])
            done += size
        if done == length:
            return out
        doubled = mixed(doubled[:-size] * np.uint64(0xD6E8FEB86659FD93) + doubled[size:])
        size *= 2


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    if len(values) < width:
        return np.empty(0, values.dtype)
    low, size = values, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(low[:n], low[width - size : width - size + n])


def numbered(words: list[bytes], at: dict[bytes, int]) -> np.ndarray:
    """The words as numbers; ``at`` learns the new ones."""
    for w in set(words).difference(at):
        at[w] = len(at)
    return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def word_hashes(at: dict[bytes, int], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in at), np.uint64, len(at))


def dealt(hashes: np.ndarray, n: int) -> np.ndarray:
    """One of ``n`` ranges for each hash."""
    return (mixed(hashes) // np.uint64((1 << 64) // n + 1)).astype(np.int64)


def ranges_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers from each start on, ``sizes`` many, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Block:
    """Texts one after the other: their words joined by single spaces, a text a line."""

    def __init__(self, text: bytes, lengths: np.ndarray, window: int):
        self.text, self.lengths, self.window = text, lengths, window
        self.ends = np.cumsum(lengths)
        self.size = int(lengths.sum())

    @cached_property
    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word begins and ends in ``text``."""
        raw = np.frombuffer(self.text, np.uint8)
        cuts = np.flatnonzero((raw == 32) | (raw == 10))
        begins, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(raw)]])
        there = ends > begins  # a line without words has none
        return begins[there], ends[there]

    @cached_property
    def starts(self) -> np.ndarray:
        """The words at which a window starts."""
        n = np.maximum(self.lengths - self.window + 1, 0)
        return ranges_of(self.ends - self.lengths, n)

    def words(self) -> tuple[np.ndarray, dict[bytes, int]]:
        at: dict[bytes, int] = {}
        return numbered(self.text.split(), at), at

    def super_kmers(self, minimiser_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each: its first word, its windows, its minimiser."""
        if not len(self.starts):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        number, at = self.words()
        pieces = run_hashes(word_hashes(at)[number], minimiser_words)
        low = sliding_minimum(pieces, self.window - minimiser_words + 1)[self.starts]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (np.diff(self.starts) != 1)])
        first = np.flatnonzero(new)
        return self.starts[first], np.diff(np.append(first, len(low))), low[first]

    def digests(self) -> np.ndarray:
        """128 bits of each window, by its first word."""
        number, at = self.words()
        return np.column_stack([run_hashes(word_hashes(at, seed)[number], self.window) for seed in (1, 2)])


class Asked:
    """What a block asks: distinct strings of the light ranges, distinct digests of the heavy ones."""

    def __init__(self, block: Block, first: np.ndarray, windows: np.ndarray, minimisers: np.ndarray, n: int, heavy: np.ndarray, n_digests: int):
        self.block, self.n = block, n
        of = dealt(minimisers, n) if len(minimisers) else np.empty(0, np.int64)
        is_heavy = np.isin(of, heavy)
        # light: each distinct string, numbered in the order of ranges
        self.first, self.windows = first[~is_heavy], windows[~is_heavy]
        of = of[~is_heavy]
        begins, ends = block.borders
        text, at = block.text, {}
        last = self.first + self.windows + block.window - 2
        number = np.fromiter(
            (at.setdefault(text[a:b], len(at)) for a, b in zip(begins[self.first].tolist(), ends[last].tolist())), np.int64, len(last)
        )
        strings = list(at)
        one = np.zeros(len(strings), np.int64)
        one[number] = np.arange(len(number))
        order = np.argsort(of[one], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number = rank[number]
        self.strings = [strings[i] for i in order.tolist()]
        self.ranges = of[one][order]
        self.sizes = self.windows[one][order]
        self.times = np.minimum(np.bincount(self.number, minlength=len(strings)), 2).astype(np.uint8)
        # heavy: each distinct window
        self.at = ranges_of(first[is_heavy], windows[is_heavy]) if is_heavy.any() else np.empty(0, np.int64)
        self.digest_ranges = np.empty(0, np.int64)
        if len(self.at):
            self.digests, self.digest_number, times = np.unique(block.digests()[self.at], axis=0, return_inverse=True, return_counts=True)
            self.digest_number = self.digest_number.ravel()
            self.digest_times = np.minimum(times, 2).astype(np.uint8)
            self.digest_ranges = dealt(self.digests[:, 0], n_digests) + n

    def questions(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Range; the strings or digests; the windows of each string (none for digests); whether each occurs more than once."""
        pack = zstandard.ZstdCompressor(level=3).compress
        for r, low, high in _runs(self.ranges):
            yield r, pack(b" ".join(self.strings[low:high])), packed(self.sizes[low:high]), pack(self.times[low:high].tobytes())
        order = np.argsort(self.digest_ranges, kind="stable")
        for r, low, high in _runs(self.digest_ranges[order]):
            some = order[low:high]
            yield r, np.ascontiguousarray(self.digests[some]).tobytes(), b"", pack(self.digest_times[some].tobytes())

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each word of the block: does a repeated window start there?"""
        out = np.zeros(self.block.size, bool)
        flags = [np.empty(0, bool)]
        for r, low, high in _runs(self.ranges):
            flags.append(_bits(answers[r], int(self.sizes[low:high].sum())))
        flat = np.concatenate(flags)
        offset = np.cumsum(self.sizes) - self.sizes
        out[ranges_of(self.first, self.windows)] = flat[ranges_of(offset[self.number], self.windows)]
        if len(self.at):
            found = np.zeros(len(self.digests), bool)
            order = np.argsort(self.digest_ranges, kind="stable")
            for r, low, high in _runs(self.digest_ranges[order]):
                found[order[low:high]] = _bits(answers[r], high - low)
            out[self.at] = found[self.digest_number]
        return out


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of sorted values: each, where it begins and ends."""
    if len(values):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1, [len(values)]]).tolist()
        for low, high in zip(cuts, cuts[1:]):
            yield int(values[low]), low, high


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), count=n).astype(bool)


def _packed_bits(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.packbits(flags).tobytes())


def repeated_windows(words: np.ndarray, hashes: np.ndarray, starts: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """For each of ``starts``: is the window of ``words`` there found twice or more, counting each as often as ``times`` says?

    Windows are sorted by hash.  Neighbours with equal hashes are compared word by word; where words differ
    all the same, the windows with that hash are sorted by their words.
    """
    if not len(starts):
        return np.empty(0, bool)
    key = run_hashes(hashes, window)[starts]
    order = np.argsort(key, kind="stable")
    equal = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    same = np.zeros(len(order), bool)
    a, b = starts[order[equal]], starts[order[equal + 1]]
    alike = np.ones(len(equal), bool)
    for d in range(window):
        alike &= words[a + d] == words[b + d]
    if not alike.all():
        for bad in np.unique(key[order[equal[~alike]]]).tolist():
            low, high = np.searchsorted(key[order], [bad, bad], side="left")[0], np.searchsorted(key[order], bad, side="right")
            part = order[low:high]
            rows = words[starts[part][:, None] + np.arange(window)]
            by_words = np.lexsort(rows.T[::-1])
            order[low:high] = part[by_words]
            same[low + 1 : high] = (rows[by_words][1:] == rows[by_words][:-1]).all(axis=1)
            alike[(equal >= low) & (equal < high - 1)] = False
    same[equal[alike] + 1] = True
    first = np.flatnonzero(~same)
    total = np.add.reduceat(times[order].astype(np.int64), first)
    out = np.empty(len(order), bool)
    out[order] = np.repeat(total > 1, np.diff(np.append(first, len(order))))
    return out


def _answer_strings(rows: list[dict], window: int) -> list[bytes]:
    at: dict[bytes, int] = {}
    words, sizes, times = [], [], []
    for r in rows:
        words.append(numbered(zstandard.ZstdDecompressor().decompress(r["asked"]).split(), at))
        sizes.append(unpacked(r["sizes"], np.int64))
        times.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["times"]), np.uint8))
    all_words, size = np.concatenate(words), np.concatenate(sizes)
    first = np.cumsum(size + window - 1) - (size + window - 1)
    flags = repeated_windows(all_words, word_hashes(at)[all_words], ranges_of(first, size), np.repeat(np.concatenate(times), size), window)
    return [_packed_bits(f) for f in np.split(flags, np.cumsum([int(s.sum()) for s in sizes])[:-1])]


def _answer_digests(rows: list[dict]) -> list[bytes]:
    asked = [np.frombuffer(r["asked"], np.uint64).reshape(-1, 2) for r in rows]
    times = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(r["times"]), np.uint8) for r in rows])
    distinct, at = np.unique(np.concatenate(asked), axis=0, return_inverse=True)
    flags = (np.bincount(at.ravel(), times, len(distinct)) > 1)[at.ravel()]
    return [_packed_bits(f) for f in np.split(flags, np.cumsum([len(x) for x in asked])[:-1])]


def _answers(window: int):
    def run(questions: pa.Table) -> pa.Table:
        rows = questions.to_pylist()
        strings = bool(rows[0]["sizes"])
        flags = _answer_strings(rows, window) if strings else _answer_digests(rows)
        return pa.table({
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "range": pa.array([r["range"] for r in rows], pa.int64()),
            "flags": pa.array(flags, pa.binary()),
        })

    return run


def _blocks(window: int, minimiser_words: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        lengths: list[int] = []

        def block() -> pa.RecordBatch:
            made = Block(b"\n".join(texts), np.array(lengths, np.int64), window)
            first, windows, minimisers = made.super_kmers(minimiser_words)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([seq], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(made.text)], pa.binary()),
                    pa.array([packed(np.diff(first, prepend=0))], pa.binary()), pa.array([packed(windows)], pa.binary()),
                    pa.array([packed(minimisers)], pa.binary()), pa.array([int(windows.sum() + (window - 1) * len(windows))], pa.int64()),
                ],
                names=["block", "ids", "lengths", "text", "first", "windows", "minimisers", "load"],
            )

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").split()
                ids.append(doc_id)
                lengths.append(len(words))
                texts.append(b" ".join(words))
                size += len(words) + 1
                if size >= BLOCK_WORDS:
                    yield block()
                    seq, size = seq + 1, 0
                    ids, texts, lengths = [], [], []
        if ids:
            yield block()

    return run


def _super_kmers(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(unpacked(row["first"], np.int64)), unpacked(row["windows"], np.int64), unpacked(row["minimisers"], np.uint64)


def _loads(n: int, window: int):
    """Words that each block's super-k-mers bring to each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = dealt(unpacked(row["minimisers"], np.uint64), n)
                if len(of):
                    ranges, at = np.unique(of, return_inverse=True)
                    words = np.bincount(at, unpacked(row["windows"], np.int64) + window - 1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(words)], names=["range", "words"])

    return run


def _asked(row: dict, n: int, heavy: np.ndarray, n_digests: int, window: int) -> Asked:
    text = zstandard.ZstdDecompressor().decompress(row["text"]) if row["text"] else b""
    block = Block(text, np.array(row["lengths"], np.int64), window)
    return Asked(block, *_super_kmers(row), n, heavy, n_digests)


def _questions(n: int, heavy: np.ndarray, n_digests: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                for r, asked, sizes, times in _asked(row, n, heavy, n_digests, window).questions():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([asked], pa.binary()),
                            pa.array([sizes], pa.binary()), pa.array([times], pa.binary()),
                        ],
                        names=["range", "block", "asked", "sizes", "times"],
                    )

    return run


def _kept(n: int, heavy: np.ndarray, n_digests: int, window: int, id_type: pa.DataType):
    """A block with its answers -> a row per text."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        asked = _asked(row, n, heavy, n_digests, window)
        block = asked.block
        starts = np.cumsum(asked.repeated({r["range"]: r["flags"] for r in answers.to_pylist()}))
        covered = starts - np.concatenate([np.zeros(min(window, block.size), np.int64), starts[:-window]]) > 0
        begins, ends = block.borders
        kept, spans = [], []
        for first, last in zip((block.ends - block.lengths).tolist(), block.ends.tolist()):
            cuts = np.flatnonzero(np.diff(covered[first:last])) + 1
            edges = [0, *cuts.tolist(), last - first] if last > first else [0]
            pieces, gone = [], []
            for a, b in zip(edges, edges[1:]):
                if covered[first + a]:
                    gone.append({"first": a, "end": b})
                else:
                    pieces.append(block.text[begins[first + a] : ends[first + b - 1]])
            kept.append(b" ".join(pieces))
            spans.append(gone)
        return pa.table({
            "doc_id": pa.array(row["ids"], id_type),
            "n_words": pa.array(row["lengths"], pa.int64()),
            "removed": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, minimiser_words: int = MINIMISER_WORDS) -> DataFrame:
    """A row per document of ``docs`` (doc_id, text).

    ``n_words``; ``removed``: the spans of words removed (``first`` word, and the word after the last);
    ``kept``: the other words, joined by single spaces.
    """
    if not 1 <= minimiser_words <= window:
        raise ValueError("a minimiser must fit into a window")
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    of_id = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(of_id)
    light = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType().add("block", "long").add("ids", T.ArrayType(of_id)).add("lengths", T.ArrayType(T.LongType()))
    for name in ("text", "first", "windows", "minimisers"):
        schema = schema.add(name, "binary")
    blocks = keep(light.mapInArrow(_blocks(window, minimiser_words, id_type), schema.add("load", "long")), "repeat_blocks", "uncompressed")
    total = blocks.agg(F.sum("load")).first()[0] or 0
    n = max(2 * spark.sparkContext.defaultParallelism, -(-total // RANGE_WORDS))
    loads = blocks.select("minimisers", "windows").mapInArrow(_loads(n, window), "range long, words long")
    too_many = max(TOO_LARGE * RANGE_WORDS, total // MAX_HEAVY)
    # fewer than MAX_HEAVY rows, as each has more than 1 / MAX_HEAVY of the words
    large = loads.groupBy("range").agg(F.sum("words").alias("words")).where(F.col("words") > too_many).toPandas()
    heavy = np.sort(large["range"].to_numpy(np.int64))
    n_digests = max(2 * spark.sparkContext.defaultParallelism, -(-int(large["words"].sum()) // RANGE_WORDS))
    questions = blocks.mapInArrow(
        _questions(n, heavy, n_digests, window), "range long, block long, asked binary, sizes binary, times binary"
    )
    answers = keep(questions.groupBy("range").applyInArrow(_answers(window), "block long, range long, flags binary"), "repeat_answers")
    out = T.StructType().add("doc_id", of_id).add("n_words", "long")
    out = out.add("removed", T.ArrayType(T.StructType().add("first", "long").add("end", "long"))).add("kept", "string")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_kept(n, heavy, n_digests, window, id_type), out)
