import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlane.config import ClassifierConfig
from factlane.operators import classifier, linear, termindex
from factlane.operators.classifier import IntentModel, NotTrainedError
from factlane.plans.classify_qa import intent_model, predict_intent
from tests.conftest import column
from factlane.functions.terms import adjacent, word_tokens


def test_tokens(spark):
    cases = {
        "门票多少钱": ["门票", "票多", "多少", "少钱"],
        "票": [], "a bc De_f 9": ["bc", "de_f"], "Supplier#01的门票": ["supplier", "01", "的门", "门票"],
        "éèç ñ": ["éèç"], "": [], None: [],
    }
    assert column(spark, word_tokens, list(cases)) == list(cases.values())
    assert column(spark, lambda c: adjacent(word_tokens(c), " "), ["ab cd ef", "ab", ""]) == [["ab cd", "cd ef"], [], []]


def test_vocabulary_limits(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["aa bb", "aa bb cc", "aa dd", "aa"])], "k long, text string")
    counts = termindex.word_terms(texts, "k", "text")
    idf = termindex.term_idf(counts, texts)
    kept = lambda **k: {r["term"] for r in termindex.prune_vocabulary(idf, texts, **k).collect()}
    assert kept(max_features=10) == {"aa", "bb", "cc", "dd"}
    assert kept(max_features=10, max_df=0.95) == {"bb", "cc", "dd"}
    assert kept(max_features=2, max_df=0.95) == {"bb", "cc"}
    assert kept(max_features=10, min_df=2) == {"aa", "bb"}


def test_sublinear_weights(spark):
    texts = spark.createDataFrame([(1, "aa aa aa bb"), (2, "bb cc")], "k long, text string")
    vocabulary = termindex.numbered(termindex.term_idf(termindex.word_terms(texts, "k", "text"), texts))
    vectors = termindex.with_vectors(termindex.with_word_counts(texts, "text", pairs=False), vocabulary, sublinear=True)
    got = {(r["k"], r["term"]): r["weight"] for r in termindex.postings(vectors, vocabulary, "k").collect()}
    idf = {"aa": math.log(3 / 2) + 1, "bb": 1.0, "cc": math.log(3 / 2) + 1}
    raw = {"aa": (1 + math.log(3)) * idf["aa"], "bb": 1.0}
    length = math.hypot(*raw.values())
    assert got[(1, "aa")] == pytest.approx(raw["aa"] / length)
    assert got[(1, "bb")] == pytest.approx(1 / length)


def test_split_is_exact_and_repeatable(spark):
    rng = random.Random(1)
    data = [(i, "hot" if rng.random() < 0.7 else rng.choice("ab")) for i in range(5000)] + [(9999, "single")]
    rows = spark.createDataFrame(data, "k long, label string").repartition(4)
    got = {r["k"]: r["is_train"] for r in classifier.stratified_split(rows, "k").collect()}
    assert len(got) == len(data)
    for label in ("hot", "a", "b", "single"):
        keys = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for k, l in data if l == label)
        quota = math.floor(len(keys) * 0.8 + 1e-9)
        assert [got[k] for _, k in keys] == [True] * quota + [False] * (len(keys) - quota)


def test_default_set_splits_evenly(spark):
    rows = classifier.label_rows(spark)
    assert rows.count() == 180 and rows.select("label").distinct().count() == 12
    counts = classifier.stratified_split(rows, "example_id").groupBy("label", "is_train").count().collect()
    assert {(r["is_train"], r["count"]) for r in counts} == {(True, 12), (False, 3)}
    assert {r["weight"] for r in classifier.class_weights(rows).collect()} == {1.0}


def test_report(spark):
    data = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")]
    rows = {r["label"]: r for r in classifier.classification_report(spark.createDataFrame(data, "label string, predicted string")).collect()}
    assert (rows["a"]["precision"], rows["a"]["recall"], rows["a"]["support"]) == (0.75, 0.75, 4)
    assert (rows["b"]["precision"], rows["b"]["recall"]) == (pytest.approx(2 / 3), 1.0)
    assert (rows["c"]["precision"], rows["c"]["recall"], rows["c"]["f1"]) == (0.0, 0.0, 0.0)
    assert rows["a"]["accuracy"] == pytest.approx(5 / 7)


def test_softmax(spark):
    values = [[1.0, 2.0, 3.0], [1000.0, 1000.0], [-5.0]]
    expected = [math.exp(3) / sum(map(math.exp, (1, 2, 3))), 0.5, 1.0]
    assert column(spark, classifier.softmax_confidence, values, "array<double>") == pytest.approx(expected)
    assert column(spark, classifier.argmax, values, "array<double>") == [2, 0, 0]


@pytest.fixture(scope="module")
def model(spark):
    return intent_model(spark)


def test_training_set_is_learned(spark, model):
    rows = classifier.label_rows(spark).withColumnRenamed("example_id", "qid")
    predicted = classifier.predict(rows, model)
    assert predicted.agg(classifier.accuracy(predicted)).first()[0] > 0.9
    confidences = [r["confidence"] for r in predicted.collect()]
    assert len(confidences) == 180 and all(0 < c <= 1 for c in confidences)


def test_saved_model_predicts_the_same(spark, model, questions, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(NotTrainedError):
        IntentModel.load(spark, path)
    model.save(path)
    before = {r["qid"]: (r["intent"], round(r["intent_confidence"], 12)) for r in predict_intent(questions, model).collect()}
    loaded = classifier.load_or_train(spark, path)
    after = {r["qid"]: (r["intent"], round(r["intent_confidence"], 12)) for r in predict_intent(questions, loaded).collect()}
    assert before == after and len(before) == 11


def test_hold_out_beats_guessing(spark):
    _, report, accuracies = classifier.evaluate(classifier.label_rows(spark), "example_id", config=ClassifierConfig(max_iter=10))
    by_part = {r["is_train"]: (r["n"], r["accuracy"]) for r in accuracies.collect()}
    assert by_part[True][0] == 144 and by_part[False][0] == 36
    assert by_part[True][1] > 0.9 and by_part[False][1] > 0.4
    assert report.agg(F.sum("support")).first()[0] == 36


def test_nothing_to_train_on(spark):
    with pytest.raises(NotTrainedError):
        classifier.train(spark.createDataFrame([], "k long, label string, text string"), "k")


def test_rows_without_a_label_are_split_too(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "key long, label string")
    got = classifier.stratified_split(rows, "key").collect()
    assert len(got) == 20
    assert sum(r["is_train"] for r in got if r["label"] is None) == 8 and sum(r["is_train"] for r in got if r["label"]) == 8


def test_more_than_two_hundred_labels(spark):
    rows = spark.createDataFrame([(f"k{i}", f"label{i % 201}", f"wort{i % 201} text") for i in range(201)], "key string, label string, text string")
    model = classifier.train(rows, "key", config=ClassifierConfig(max_iter=2))
    assert len(model.labels) == 201


def test_a_class_that_stops_early_is_warned_of(spark):
    rows = classifier.label_rows(spark)
    with pytest.warns(UserWarning, match="max_iter"):
        classifier.train(rows, "example_id", config=ClassifierConfig(max_iter=1))


def test_defaults_train_to_convergence():
    # the reference trains with max_iter=10000 and the usual tolerance of 1e-4
    assert (ClassifierConfig().tolerance, ClassifierConfig().max_iter) == (1e-4, 10_000)


def exact_weights(x, y, weight, c):
    """Newton's method on the squared hinge, to the last digit; the intercept is the last column's weight."""
    w = np.zeros(x.shape[1])
    for _ in range(100):
        short = np.maximum(1 - y * (x @ w), 0)
        gradient = w - 2 * c * x.T @ (weight * y * short)
        on = x[short > 0]
        hessian = np.eye(len(w)) + 2 * c * on.T @ (weight[short > 0][:, None] * on)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-12:
            break
    short = np.maximum(1 - y * (x @ w), 0)
    return w, w @ w / 2 + c * (weight * short * short).sum()


@pytest.mark.parametrize("partitions, block", [(1, 1024), (5, 7)])
def test_all_classes_reach_the_exact_minimum(spark, monkeypatch, partitions, block):
    monkeypatch.setattr(linear, "BLOCK_FEATURES", block)
    monkeypatch.setattr(linear, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(4)
    width, classes, c = 30, 4, 1.0
    rows = []
    for i in range(230):
        label = min(i % 7, 3)
        terms = sorted(set(rng.integers(0, width, 6).tolist()) | {label})
        values = rng.random(len(terms))
        rows.append((label, 0.5 + (i % 3), terms, (values / np.linalg.norm(values)).tolist()))
    rows.append((0, 1.0, [], []))
    data = spark.createDataFrame(rows, "target int, weight double, terms array<int>, weights array<double>").repartition(partitions).persist()
    got, done = linear.fit(data, width, classes, c, 1e-4, 1000)
    assert done.all()
    x = np.zeros((len(rows), width + 1))
    for i, (_, _, terms, values) in enumerate(rows):
        x[i, terms] = values
    x[:, width] = 1
    target, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for k in range(classes):
        y = np.where(target == k, 1.0, -1.0)
        w, best = exact_weights(x, y, weight, c)
        short = np.maximum(1 - y * (x @ got[:, k]), 0)
        value = got[:, k] @ got[:, k] / 2 + c * (weight * short * short).sum()
        assert best - 1e-9 <= value <= best * (1 + 1e-4)
        assert np.abs(got[:, k] - w).max() < 0.05
    decided = linear.decide(data.withColumn("own", F.col("terms")), got, tuple("abcd")).collect()
    assert len(decided) == len(rows)
    for r in decided:
        assert min(np.abs(x[i] @ got - r.decisions).max() for i, row in enumerate(rows) if row[2] == r.own) < 1e-12
        assert r.predicted == "abcd"[int(np.argmax(r.decisions))] and r.confidence == pytest.approx(1 / sum(np.exp(np.array(r.decisions) - max(r.decisions))))
    data.unpersist()
