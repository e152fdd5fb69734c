"""Toxicity and compression: held-out accuracy, calibration, edge cases."""

import random
import zlib

import numpy as np
import pytest

from factlane.llm import compression, learn, toxicity

WORDS = ["".join(random.Random(i).choice("abcdefgh") for _ in range(2 + i % 5)) for i in range(300)]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(11)
    docs, labels = [], []
    for i in range(500):
        toxic = i % 5 == 0
        poor = i % 7 == 0
        words = [r.choice(WORDS) for _ in range(r.randint(20, 120))]
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = "Zorgul" + r.choice(WORDS)
        if poor:
            words = [w + "***" for w in words]
        docs.append((i, " ".join(words), "l", "s", 0.5))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(900, None, "l", "s", 0.1), (901, "", None, None, 0.1), (902, "x" * 300_000, "l", "s", 0.1), (None, "abc", "l", "s", 0.1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("module, label, threshold", [(toxicity, 1, toxicity.THRESHOLD), (compression, 0, compression.THRESHOLD)])
def test_held_out_accuracy(tables, module, label, threshold):
    docs, labels = tables
    model = module.fit(docs, learn.learnable(labels))
    scored = module.score(docs.select("doc_id", "text"), model)
    score = {r.doc_id: r.score for r in scored.collect()}
    assert len(score) == 504 and all(0 <= s <= 1 for s in score.values())
    truth = {r.doc_id: (r.quality, r.toxic)[label] for r in labels.collect()}
    right = [(score[i] >= threshold) == truth[i] for i in truth if held_out(i)]
    assert len(right) > 80 and np.mean(right) >= 0.95


def test_labels_of_the_held_out_quarter_are_not_learned(tables):
    docs, labels = tables
    assert not any(held_out(r.doc_id) for r in learn.learnable(labels).collect())


def test_without_labels(spark, tables):
    docs, labels = tables
    for module, label in ((toxicity, "toxic"), (compression, "quality")):
        for some, want in ((labels.limit(0), 0.0), (labels.where(f"{label} = 1"), 1.0)):
            model = module.fit(docs, some)
            assert {r.score for r in module.score(docs.select("doc_id", "text"), model).collect()} == {want}
        none = module.score(docs.limit(0), module.fit(docs, labels))
        assert none.collect() == []


def test_keep_ordinary_keeps_columns(tables):
    docs, labels = tables
    kept = toxicity.keep_ordinary(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(ids & toxic) <= 5 and len(ids - toxic) >= 390 and {None, 900, 901, 902} <= ids


def plain_kneser_ney(counts, order, discount):
    """Probabilities from the definition, with dictionaries: counts[class][gram] of ``order`` bytes, newest last."""
    both = set(counts[0]) | set(counts[1])
    lower = {}
    for n in range(order - 1, 0, -1):
        longer = {g[-(n + 1) :] for g in both}
        lower[n] = {}
        for g in longer:
            lower[n][g[1:]] = lower[n].get(g[1:], 0) + 1

    def level(table, gram, below):
        follow = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        if not follow:
            return below
        total = sum(follow.values())
        return max(table.get(gram, 0) - discount, 0) / total + discount * len(follow) / total * below

    def p(cls, gram):
        value = 1 / 256
        for n in range(1, order):
            value = level(lower[n], gram[-n:], value)
        return level(counts[cls], gram, value)

    return p


def test_kneser_ney_from_its_definition():
    order = 3
    words = [b"abc", b"abd", b"xbc", b"abc", b"dda"]
    counts = [{}, {}]
    for i, w in enumerate(words):
        padded = toxicity.PAD * (order - 1) + w + b" "
        for j in range(order - 1, len(padded)):
            gram = padded[j - order + 1 : j + 1]
            counts[i % 2][gram] = counts[i % 2].get(gram, 0) + 1
    number = lambda g: int.from_bytes(g, "big")
    grams = sorted(set(counts[0]) | set(counts[1]), key=number)
    got = toxicity.ClassModels.fit(
        np.array([number(g) for g in grams]), np.array([counts[1].get(g, 0) for g in grams]),
        np.array([counts[0].get(g, 0) for g in grams]), order,
    )
    p = plain_kneser_ney(counts, order, toxicity.DISCOUNT)
    for w in (b"abc", b"xbd", b"zzz", b"a"):
        padded = toxicity.PAD * (order - 1) + w + b" "
        want = sum(np.log(p(1, g) / p(0, g)) for g in (padded[j - order + 1 : j + 1] for j in range(order - 1, len(padded))))
        assert got.difference([w])[0] == pytest.approx(want)


def test_logistic_and_share():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 1))
    y = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0])))).astype(float)
    w = learn.fit_logistic(x, y)
    assert abs(w[0] - 0.5) < 0.2 and abs(w[1] - 2) < 0.3
    assert learn.for_share(w, 0.5, 0.5) == pytest.approx(w)
    assert learn.for_share(w, 0.5, 0.1)[0] < w[0]


def test_sample_holds_one_row_of_each_id(spark):
    from factlane.llm.learn import sample

    docs = spark.createDataFrame([(0, f"text {i}") for i in range(50)] + [(i, f"own {i}") for i in range(1, 9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    got = sample(docs, labels, "toxic", 10, "seed").collect()
    assert len(got) == 9 and sorted(r.label for r in got) == [0] * 5 + [1] * 4
    assert {r.text for r in got} > {f"own {i}" for i in range(1, 9)}
    assert {tuple(r) for r in got} == {tuple(r) for r in sample(docs.repartition(3), labels, "toxic", 10, "seed").collect()}


@pytest.mark.parametrize("scored, model", [
    (toxicity.score, toxicity.ToxicityModel(None, None, 0.25)),
    (compression.score, compression.CompressionModel(None, None, None, None, 0.25)),
])
def test_a_column_named_like_the_score_is_replaced(spark, scored, model):
    rows = [(1, "a", "old", 7), (2, None, None, 8), (3, "", "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score string, _score int")
    for keep_text in (False, True):
        out = scored(docs, model, keep_text=keep_text).select("doc_id", "score", "_score").collect()
        assert sorted(map(tuple, out)) == [(1, 0.25, 7), (2, 0.25, 8), (3, 0.25, 9)]
