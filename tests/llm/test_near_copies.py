import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from factlane.llm.near_copies import components, fingerprint, keep_one_of_each, near_copies, segment_masks, spanning_forest


def plain_fingerprint(text):
    """Straight from the definition."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """doc_id -> smallest id reachable over fingerprints at 3 bits or fewer."""
    prints = {i: plain_fingerprint(t) for i, t in rows}
    group = {i: i for i in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.choice([1, 2, 3, 5, 60, 200]))) for _ in range(60)]
    for base in texts[:25]:
        words = base.split()
        for _ in range(r.randint(0, 8)):
            changed = list(words)
            for _ in range(r.randint(0, 2)):
                changed[r.randrange(len(changed))] = word()
            texts.append(r.choice([" ", "\t", "\n\n"]).join(changed))
    texts += ["", None, "  \n", "ONE two", "one TWO", texts[30] * 3, "x " * 50_000]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_fingerprint_is_the_defined_one(rows):
    for _, text in rows:
        assert fingerprint((text or "").encode()) == plain_fingerprint(text)
    assert fingerprint(b"") == 0
    assert fingerprint(b"A b") == xxhash.xxh64(b"a b", seed=42).intdigest()


def test_components_match_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_copies(docs).collect()}
    assert got == plain_components(rows)


def test_many_fingerprints_in_one_segment_value(spark, monkeypatch):
    from factlane.llm import near_copies as module

    monkeypatch.setattr(module, "BLOCK", 4)
    r = random.Random(5)
    prints = {r.getrandbits(12) for _ in range(300)} | {r.getrandbits(64) for _ in range(50)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = module.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    root = {row.node: row.root for row in components(edges).collect()}
    seen = {}
    for a in signed:
        for b in signed:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                assert root.get(a, a) == root.get(b, b)
        seen.setdefault(root.get(a, a), a)


def test_segment_masks_cover_all_small_differences():
    for max_bits, segments in ((3, 2), (3, 4), (4, 2), (2, 3)):
        masks = segment_masks(max_bits, segments)
        r = random.Random(1)
        for _ in range(300):
            diff = sum(1 << b for b in r.sample(range(64), max_bits))
            assert any(diff >> shift & mask in ball for shift, mask, ball in masks)


def test_spanning_forest_and_stars(spark):
    r = random.Random(7)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    hi, lo = spanning_forest(*np.array(edges).T)
    stars = dict(zip(hi.tolist(), lo.tolist()))
    pairs = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    found = {x.node: x.root for x in components(spark.createDataFrame(pairs, "hi long, lo long")).collect()}
    assert found == stars
    assert len(hi) <= len({x for e in edges for x in e})


def test_one_of_each_stays(spark):
    a, b = "one two three four five " * 9, "six seven eight nine ten " * 9
    rows = [(1, a, "p"), (2, a, "q"), (3, b, "r"), (3, b, "r"), (2, b, "s"), (None, a, "t"), (None, "alone " * 9, "u"), (None, "alone " * 9, "v"), (7, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    # b's smallest id is 2, which also stands at a copy of a; of the two rows without id one stays
    assert got == Counter([(1, a), (2, b), (None, "alone " * 9), (7, None)])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert near_copies(docs).collect() == []
    assert keep_one_of_each(docs).collect() == []
