import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factlane.llm import interpolated_lm as lm


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5


def plain(rows):
    """Base counts and scores, and the model's, from dictionaries."""
    pairs = lambda t: zip([None] + t[:-1], t)
    split = [(fold(i), tokens(t)) for i, t in rows]
    one, two = (Counter(x for f, t in split if f != 1 for x in of(t)) for of in (list, pairs))
    gone1, gone2 = (Counter(x for f, t in split if f == 0 for x in of(t)) for of in (list, pairs))
    n, v = sum(one.values()), len(one)
    bucket = lambda c: 0 if c <= 0 else int(math.log2(c)) + 1
    left = n - sum(gone1.values())
    seen = []
    for f, t in split:
        if f == 0:
            for a, b in pairs(t):
                c = one[a] - gone1[a]
                seen.append((bucket(c), (two[a, b] - gone2[a, b]) / max(c, 1), (one[b] - gone1[b]) / max(left, 1), 1 / (v + 1)))
    seen = np.array(seen).reshape(-1, 4)

    def learn(p, mix, added):
        for _ in range(lm.ITERATIONS):
            part = p * mix
            mix = (part / part.sum(axis=1, keepdims=True)).sum(axis=0) + added
            mix /= mix.sum()
        return mix

    overall = learn(seen[:, 1:], np.full(3, 1 / 3), np.full(3, 1 / 3))
    weights = np.array([learn(seen[seen[:, 0] == b, 1:], overall, 3 * overall) for b in range(lm.BUCKETS)])
    weights[0, 0] = 0
    weights = np.maximum(weights, [0, 1e-6, 1e-6])
    weights /= weights.sum(axis=1, keepdims=True)
    out = []
    for (f, t), (i, _) in zip(split, rows):
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        score = sum(math.log10(weights[bucket(one[a])] @ [two[a, b] / max(one[a], 1), one[b] / max(n, 1), 1 / (v + 1)]) for a, b in pairs(t))
        out.append((i, f == 1, len(t), sum(one[x] > 0 for x in t), n, base, score))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(400)] + ["É", "the", "The", " "]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 20, 150]))) for _ in range(120)]
    return [*enumerate(texts), (500, None), (501, "long " * 40_000), (None, "a b"), (3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize("block_tokens", [300, 1_000_000])
def test_scores_match_brute_force(spark, rows, monkeypatch, block_tokens):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block_tokens)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = sorted(map(tuple, lm.score(docs).collect()), key=str)
    want = sorted(plain(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=0.02)


def test_probabilities_add_up():
    cells = np.array([5, 700, 90_000])
    weights = lm.learn_weights(cells, np.array([3.0, 2.0, 1.0]), 10)
    assert weights.shape == (lm.BUCKETS, 3) and np.allclose(weights.sum(axis=1), 1) and (weights[:, 1:] > 0).all()
    assert weights[0, 0] == 0


def test_packing_of_numbers():
    for kind in (np.uint32, np.uint64, np.int64):
        values = np.random.default_rng(1).integers(0, 2**31, 1000).astype(kind)
        assert (lm.unpacked(lm.packed(values), kind) == values).all()
        assert len(lm.unpacked(lm.packed(values[:0]), kind)) == 0


def test_no_training_texts_and_empty_table(spark):
    only_test = [(i, "a b") for i in range(200) if fold(i) == 1][:3]
    out = lm.score(spark.createDataFrame(only_test, "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in out] == [(3, 0, 0, pytest.approx(0, abs=1e-5))] * 3
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
