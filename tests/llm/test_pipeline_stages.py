"""Each stage on planted rows, against plain Python on the stage's own input."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from factlane.llm import mixing, near_copies, quality_rules
from tests.llm.test_quality_rules import plain_counts, plain_fit

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, copies int"
STAGES = dict(corpus_pipeline.STAGES)


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(31)
    out = [(i, prose(r, r.randint(60, 200)), "en", r.choice(["a", "a", "a", "b", None]), i, "x", 7) for i in range(120)]
    junk = [(500 + i, " ".join(w + "***" for w in prose(r, 80).split()), "en", "a", 0, "x", 7) for i in range(6)]
    short = [(600, "too short", "en", "a", 1, "x", 7), (601, None, None, None, None, None, None), (602, "", "", "", 0, "", 0)]
    # copies, exact and with one word changed of many, and the same row twice
    long = prose(r, 1500)
    copies = [(700 + i, out[3][1], "en", "b", 2, "y", 8) for i in range(5)] + [(800, long, "en", "a", 3, "x", 7), (801, long + " end", "en", "b", 3, "x", 7)]
    return out + junk + short + copies + [out[9], out[9], (None, out[11][1], "en", "a", 4, "x", 7), (900, "wort " * 30_000, "de", "b", 5, "x", 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_quality_rules_keep_what_the_model_keeps(spark, docs, rows):
    judged = quality_rules.judge(docs).collect()
    quality = plain_fit(Counter(r.votes for r in judged), quality_rules.sides())
    want = Counter()
    for r in judged:
        n, _, _, _, repeated = plain_counts(r.text)
        if n >= 50 and 100 * repeated <= 50 * n and quality[r.votes] >= quality_rules.MIN_QUALITY:
            want[r.doc_id] += 1
    kept = STAGES["quality_rules"](spark, docs, FOLDER)
    assert kept.columns == docs.columns and ids(kept) == want
    assert not want.keys() & {500, 505, 600, 601, 602, 900} and len(want.keys() & set(range(120))) == 120


def test_one_of_each_group_of_near_copies_stays(spark, docs, rows):
    prints = [near_copies.fingerprint((r[1] or "").encode()) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= near_copies.MAX_BITS:
                group = [group[j] if g == group[i] else g for g in group]
    smallest = {}
    for (i, *_), g in zip(rows, group):
        smallest[g] = min((x for x in (smallest.get(g), i) if x is not None), default=None)
    kept = STAGES["near_copies"](spark, docs, FOLDER)
    assert kept.columns == docs.columns and ids(kept) == Counter(smallest.values())
    assert not ids(kept).keys() & {700, 704} and ids(kept)[9] == 1


def test_mixing_takes_what_the_mix_says(spark, docs, rows):
    sizes, sources = Counter(), [r[3] for r in rows]
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))], sum(sizes.values()))))
    mixed = STAGES["mixing"](spark, docs, FOLDER)
    got = mixed.collect()
    assert mixed.columns == docs.columns and {tuple(r) for r in got} <= set(rows)
    most = Counter(rows)
    assert all(n <= 3 * most[tuple(r)] for r, n in Counter(map(tuple, got)).items())
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r.source] += len((r.text or "").split())
    for r, s in zip(rows, sources):
        largest[s] = max(largest[s], len((r[1] or "").split()))
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 1) for s in order)
    assert Counter(map(tuple, STAGES["mixing"](spark, docs.repartition(5), FOLDER).collect())) == Counter(map(tuple, got))


def test_packing_keeps_every_row(spark, docs, rows):
    packed = STAGES["packing"](spark, docs, FOLDER)
    got = packed.collect()
    assert Counter(tuple(r[: len(rows[0])]) for r in got) == Counter(rows)
    assert all(r.length == len((r.text or "").split()) <= r.bucket for r in got)


def test_toxicity_drops_the_toxic_and_keeps_the_rest(spark):
    """On the given tables, as the models learn from their labels."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = STAGES["toxicity"](spark, docs, FOLDER)
    there, before = ids(kept), ids(docs)
    assert kept.columns == docs.columns and all(n == before[i] for i, n in there.items())
    bad, good = [i for i, t in toxic.items() if t == 1], [i for i, t in toxic.items() if t == 0]
    assert sum(i in there for i in bad) <= 0.1 * len(bad) and sum(i in there for i in good) >= 0.95 * len(good)
