import random
import re
import zlib
from collections import Counter

import pytest

from factlane.llm import spelling


def plain_counts(rows, misspelt=97):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def one_apart(a, b):
    """Straight from the definition."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio=2):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_groups_match_brute_force(spark, partitions):
    r = random.Random(12)
    words = {"".join(r.choice("abÿ") for _ in range(r.randint(1, 7))) for _ in range(500)} | {"a" * 300, "a" * 299, "a" * 150 + "b" + "a" * 149, "zz"}
    # falling counts make chains of forms
    counts = {w: int(2 ** r.uniform(0, 14)) for w in words}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows_of(spelling.group_words(spark.createDataFrame(list(counts.items()), "word string, n long")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_groups(counts)


@pytest.mark.parametrize("partitions", [1, 6])
def test_trie_nodes_are_prefixes(spark, partitions, monkeypatch):
    r = random.Random(3)
    texts = sorted({"".join(r.choice("xy\U0001f600") for _ in range(r.randint(0, 9))) for _ in range(300)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = spelling.trie_paths(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    node = {}
    for row in out:
        assert len(row.path) == len(row.t) + 1 and row.path[0] == 0
        for i, number in enumerate(row.path):
            assert node.setdefault(row.t[:i], number) == number
    assert len(set(node.values())) == len(node)
    assert [x.t for x in sorted(out, key=lambda x: x.place)] == sorted(texts, key=lambda t: t.encode())


def test_texts(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = ["Straße", "strasse", "naïve", "naive", "NAÏVE", "don't", "x×y÷z", "ŒUVRE", "mot", "été", "abcde中abcde", "word1word2"]
    vocabulary += ["".join(r.choice("abcdeé") for _ in range(r.randint(4, 7))) for _ in range(60)]
    rows = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randint(0, 80)))) for i in range(90)]
    rows += [(None, rows[1][1]), (5, None), (6, ""), (7, "long " * 30_000), (8, "q" * 20_000), (9, "q" * 20_000), (10, "q" * 20_000), rows[2], rows[2]]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    monkeypatch.setattr(spelling, "HELD_WORDS", 40)
    assert {r.word: r.n for r in spelling.words(docs, misspelt=3, min_length=1, min_count=1).collect()} == {
        w: n for w, n in plain_counts(rows, 3).items() if w
    }
    got = rows_of(spelling.variants(docs))
    assert got == plain_groups({w: n for w, n in plain_counts(rows).items() if len(w) >= 5 and n >= 3})


def test_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "ab 12")], "doc_id long, text string")).collect() == []
    assert spelling.group_words(spark.createDataFrame([(None, 3)], "word string, n long")).collect() == []
