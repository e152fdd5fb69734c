import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factlane.llm import quality_rules as q


def plain_counts(text):
    """Straight from the definition."""
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)
    )


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["a", "b", "cc", "é", "ß#", "|", " x", "<p>", "\U0001f600"]
    made = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", "\n\n", "\r\n", "\x0b", " \f"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 9, 30, 60, 200, 500) for _ in range(6)]
    return [*made, None, "", " \n ", "a a a", "a a a a", "x y z\nx y z\nx y z", "Wort " * 30_000, "A!! " * 60]


def test_base_counts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in q.judge(docs).collect():
        n, chars, symbols, lines, repeated = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated), repr(r.text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.kept and r.base_failed)


def plain_fit(patterns, sides):
    share = q.START_SHARE
    starts = [
        dict(g1=q.GOOD_RIGHT * good, b1=q.GOOD_WRONG * good, b0=q.BAD_RIGHT * bad, g0=q.MIN_WRONG * bad) for good, bad in sides
    ]
    rates = [dict(s) for s in starts]

    def quality(votes):
        odds = math.log(share / (1 - share))
        for r, v in zip(rates, votes):
            if v == "-":
                odds += math.log(max(q.MIN_WRONG, 1 - r["g1"] - r["g0"]) / max(q.MIN_WRONG, 1 - r["b1"] - r["b0"]))
            else:
                odds += math.log(r["g" + v] / r["b" + v])
        return 1 / (1 + math.exp(-odds))

    for _ in range(q.ITERATIONS):
        post = {v: quality(v) for v in patterns}
        good = sum(n * post[v] for v, n in patterns.items())
        poor = sum(n * (1 - post[v]) for v, n in patterns.items())
        for j, s in enumerate(starts):
            for name, start in s.items():
                of = (lambda v: post[v]) if name[0] == "g" else (lambda v: 1 - post[v])
                voted = sum(n * of(v) for v, n in patterns.items() if v[j] == name[1])
                rates[j][name] = start and max(q.MIN_WRONG, (q.START_WEIGHT * start + voted) / (q.START_WEIGHT + (good if name[0] == "g" else poor)))
            rates[j]["g1"], rates[j]["b0"] = max(rates[j]["g1"], rates[j]["b1"]), max(rates[j]["b0"], rates[j]["g0"])
        share = (10 * q.START_SHARE + good) / (10 + good + poor)
    return {v: quality(v) for v in patterns}


@pytest.mark.parametrize("sides", [[(True, True)] * 4, [(True, False), (True, True), (False, True), (False, True)]])
def test_expectation_maximisation(spark, sides):
    r = random.Random(6)
    vote = lambda good, bad: r.choice("-" + "1" * good + "0" * bad)
    patterns = {"".join(vote(*s) for s in sides): r.randint(1, 900) for _ in range(30)}
    table = spark.createDataFrame(list(patterns.items()), "votes string, n long")
    got = {x.votes: x.quality for x in q.pattern_quality(table, sides).collect()}
    want = plain_fit(patterns, sides)
    assert got.keys() == want.keys()
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)


@pytest.mark.parametrize("clean, poor", [(60, 8), (950, 50), (990, 10), (999, 1), (99_900, 100), (30, 70)])
def test_rare_faults_are_found(spark, clean, poor):
    """Patterns as clean texts and texts full of symbols make them, at 12 %, 5 %, 1 %, 0.1 % and most of the texts."""
    names = list(q.RULES)
    of = lambda **votes: "".join(votes.get(x, "-") for x in names)
    good, bad = of(prose="1", varied="1"), of(symbols="0", letters="0")
    table = spark.createDataFrame([(good, clean), (bad, poor)], "votes string, n long")
    got = {x.votes: x.quality for x in q.pattern_quality(table, q.sides()).collect()}
    assert got[good] > 0.9 and got[bad] < 0.1


def test_verdicts_follow_posterior(spark):
    good = [(i, " ".join(f"wort{(7 * i + k) % 500}" for k in range(80)) + ".") for i in range(60)]
    junk = [(100 + i, " ".join(f"wort{(3 * i + k) % 500}***" for k in range(80))) for i in range(8)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    assert {r.doc_id for r in q.keep_good(docs).collect()} == {i for i, _ in good}


@pytest.mark.parametrize("clean, poor", [(190, 10), (198, 2), (999, 1)])
def test_rare_junk_goes_and_clean_texts_stay(spark, clean, poor):
    word = lambda n: "wort" + chr(97 + n % 26) + chr(97 + n // 26)
    good = [(i, " ".join(word((7 * i + k) % 500) for k in range(80)) + ".") for i in range(clean)]
    junk = [(5000 + i, " ".join(word((3 * i + k) % 500) + "***" for k in range(80))) for i in range(poor)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    assert {r.doc_id for r in q.keep_good(docs).collect()} == {i for i, _ in good}


def test_callers_columns_stay(spark):
    docs = spark.createDataFrame([(1, "w " * 60, 5, "x", 2.0)], "doc_id long, text string, _words int, _Lines string, _bare double")
    row = q.judge(docs).first()
    assert (row["_words"], row["_Lines"], row["_bare"], row["n_words"]) == (5, "x", 2.0, 60)


def test_clashing_columns_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, 5, "x"), (1, "w " * 60, 6, "y")], "doc_id long, text string, n_words int, Quality string")
    out = q.judge(docs)
    assert sorted(out.columns) == sorted(["votes", "doc_id", "text", *q.BASE, "base_failed", "quality", "kept"])
    assert {r.doc_id: r.n_words for r in out.collect()} == {None: 0, 1: 60}
    assert q.keep_good(docs).columns == docs.columns
    assert q.judge(docs.limit(0)).collect() == []
    assert q.keep_good(docs.where(F.lit(False))).collect() == []


def test_main_path_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = q.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
