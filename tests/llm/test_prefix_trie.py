import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factlane.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def rebuilt(rows):
    """Each conversation's turns after rebuilding, by id."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own[c].append(((turn is not None, turn or 0), role, digest(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(turns, key=lambda x: (x[0], x[1].encode(), x[2]))] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = None if c is None else c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + turns[h:] if h else turns
    return out


def plain(rows):
    """A row per node, straight from the definition."""
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    smallest = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if c is not None and len(convs[c]) == len(p))
        out.append((
            smallest[p], len(p), smallest[p[:-1]] if p else None, len(m), children[p], sum(not children[q] for q in below[p]),
            sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below[p] if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.prefix_trie(docs).collect()), key=str)


def made(seed, n, longest):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(-30, 200), n):
        size = r.choice([1, 2, 3, r.randint(1, longest)])
        out += [(c, t, r.choice(["user", "user", None]), r.choice(["a b", "a b", "a b", "c", "", None])) for t in range(size)]
    return out


@pytest.mark.parametrize("seed, n, longest, partitions", [(1, 60, 9, 1), (2, 120, 4, 5), (3, 25, 70, 3)])
def test_matches_brute_force(spark, seed, n, longest, partitions):
    rows = made(seed, n, longest)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    assert result(docs) == plain(rows)


def test_nulls_ties_copies_long_texts_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [(c, t, "user", f"hello {t}") for c in range(40, 80) for t in range(3)]
    rows += [(None, 0, "user", "hello 0"), (None, None, None, None), (None, 0, "user", "hello 0")]
    rows += [(7, 5, "user", "x"), (7, 5, "user", "x"), (7, 5, "assistant", "y"), (7, None, "user", "z"), (7, -3, "a", "b")]
    rows += [(8, 1, "us", "er"), (8, 2, "use", "r"), (9, 0, "u", "word " * 50_000), (100, 0, "u", "word " * 50_000), (121, 1, "", "")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA + ", node string, depth int")
    assert result(docs) == plain(rows)
    assert prefix_trie.prefix_trie(docs.where(F.lit(False))).collect() == []


def test_a_conversation_in_many_partitions(spark):
    rows = [(3, t, "u", f"{t % 3}") for t in range(300)] + [(c, 0, "u", "0") for c in range(20, 30)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(spark.createDataFrame(rows, SCHEMA).repartition(6)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
