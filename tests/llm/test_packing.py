import random
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from factlane.llm import packing


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


def test_bounds_are_the_best():
    r = random.Random(3)
    for _ in range(40):
        lengths = [r.choice([0, 1, 2, 5, r.randint(0, 60)]) for _ in range(r.randint(1, 40))]
        cells = Counter(lengths)
        largest = np.array(sorted(cells))
        counts = np.array([cells[x] for x in largest.tolist()])
        k = r.randint(1, 4)
        got = packing.best_bounds(largest, counts, largest * counts, k)
        assert len(got) <= k and got[-1] == max(lengths) and got == sorted(set(got))
        distinct = sorted(cells)
        best = min(padding(lengths, [*some, distinct[-1]]) for n in range(min(k, len(distinct))) for some in combinations(distinct[:-1], n))
        assert padding(lengths, got) == best


def test_long_lengths_are_exact(spark):
    """Lengths far above 512 words, through the whole of ``bucket_bounds``."""
    r = random.Random(9)
    lengths = [r.choice([r.randint(500, 530), r.randint(10_000, 10_040), r.randint(100_000, 131_000)]) for _ in range(60)]
    got = packing.bucket_bounds(spark.createDataFrame([(n,) for n in lengths], "length long"), 3)
    distinct = sorted(set(lengths))
    best = min(padding(lengths, [*some, distinct[-1]]) for some in combinations(distinct[:-1], 2))
    assert len(got) == 3 and padding(lengths, got) == best


def test_many_lengths_take_seconds():
    largest = np.arange(1, 60_001)
    counts = np.random.default_rng(1).integers(1, 50, len(largest))
    start = time.perf_counter()
    assert len(packing.best_bounds(largest, counts, largest * counts, 16)) == 16
    assert time.perf_counter() - start < 30


def test_cells_hold_lengths(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 2, 255, 256, 257, 511, 512, 513, 1025, 123_456, 131_071, 131_073, 10**9]
    rows = spark.createDataFrame([(v,) for v in values], "n long").select("n", packing.length_cell(F.col("n")).alias("c")).collect()
    for r in rows:
        assert r.n <= r.c <= r.n * (1 + 1 / 65_536)
        assert r.n > 131_072 or r.c == r.n


@pytest.mark.parametrize("partitions", [1, 5])
def test_batches(spark, partitions):
    r = random.Random(4)
    rows = [(i if i % 10 else None, "w " * r.choice([0, 1, 7, 7, 7, 30, 100, 400]), "b") for i in range(600)]
    rows += [(5000, "w " * 3000, "b"), rows[3], rows[3], (6000, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Bucket string").repartition(partitions)
    out = packing.pack(docs, buckets=4, budget=1000).collect()
    assert len(out) == len(rows)
    assert Counter(x.text for x in out) == Counter(x[1] for x in rows)
    bounds = sorted({x.bucket for x in out})
    assert len(bounds) <= 4
    batches = defaultdict(list)
    for x in out:
        assert x.length == len((x.text or "").split()) and x.padding == x.bucket - x.length
        assert x.bucket == min(b for b in bounds if b >= x.length)
        batches[x.bucket, x.batch].append(x.slot)
    full = {b: max(1000 // max(b, 1), 1) for b in bounds}
    for (bucket, batch), slots in batches.items():
        last = max(n for b, n in batches if b == bucket)
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) == full[bucket] or batch == last
    assert all({n for b, n in batches if b == bucket} == set(range(1 + max(n for b, n in batches if b == bucket))) for bucket in bounds)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
