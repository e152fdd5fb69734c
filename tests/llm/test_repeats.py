import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factlane.llm import repeats


def plain(rows, window):
    """Straight from the definition: (id, words, removed, digest of what is kept)."""
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = {k + d for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for d in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def result(docs, **options):
    rows = repeats.remove_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.first for s in r.removed), hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(300)] + ["É", " x", "\U0001f600", "a"]
    passages = [[r.choice(words) for _ in range(n)] for n in (4, 5, 6, 9, 40)]
    out = []
    for i in range(150):
        text = []
        for _ in range(r.choice([0, 1, 2, 5])):
            text += [r.choice(words) for _ in range(r.randint(0, 12))]
            text += r.choice(passages)
        out.append((i, r.choice([" ", "\n", "  ", " \t"]).join(text)))
    out += [(200, None), (201, ""), (202, " \n "), (203, "a " * 500), (204, "a " * 30), (205, "x y " * 40), (None, "a b c d e f g")]
    return out + [out[3], out[3], (3, out[7][1])]


@pytest.mark.parametrize("block_words, range_words", [(50, 400), (100_000, 60), (100_000, 10**7)])
@pytest.mark.parametrize("window, minimiser", [(5, 2), (5, 5), (35, 4), (1, 1)])
def test_matches_brute_force(spark, rows, monkeypatch, block_words, range_words, window, minimiser):
    # small ranges are too large for strings, so their windows go one by one
    monkeypatch.setattr(repeats, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(repeats, "RANGE_WORDS", range_words)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, block string").repartition(3)
    assert result(docs, window=window, minimiser_words=minimiser) == plain(rows, window)


def test_empty_tables_and_other_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert repeats.remove_repeats(empty).collect() == []
    docs = spark.createDataFrame([("a", None), ("b", "x " * 80)], "doc_id string, text string")
    assert result(docs) == plain([("a", None), ("b", "x " * 80)], 35)


def test_equal_hashes_are_told_apart():
    words = np.array([1, 2, 3, 9, 2, 3, 1, 2, 3, 9, 9, 9])
    starts = np.array([0, 3, 6, 9])
    # all windows have one hash
    got = repeats.repeated_windows(words, np.zeros(len(words), np.uint64), starts, np.array([1, 1, 1, 1]), 3)
    assert got.tolist() == [True, False, True, False]
    got = repeats.repeated_windows(words, np.zeros(len(words), np.uint64), starts, np.array([1, 2, 1, 1]), 3)
    assert got.tolist() == [True, True, True, False]


@pytest.mark.parametrize("length", [1, 2, 3, 4, 7, 35])
def test_hashes_of_runs(length):
    values = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    got = repeats.run_hashes(values, length)
    runs = [tuple(values[i : i + length].tolist()) for i in range(len(values) - length + 1)]
    assert len(got) == len(runs) and len(set(zip(got.tolist(), runs))) == len(set(runs)) == len(set(got.tolist()))
    low = repeats.sliding_minimum(values, length)
    assert low.tolist() == [min(run) for run in runs]


def test_strings_are_shorter_than_windows():
    r = random.Random(5)
    text = b" ".join(b"w%d" % r.randrange(900) for _ in range(20_000))
    block = repeats.Block(text, np.array([20_000]), 35)
    first, windows, minimisers = block.super_kmers(4)
    assert windows.sum() == 20_000 - 34
    assert (windows + 34).sum() < 3.3 * 20_000
