import math
import random

import pytest
from pyspark.sql import functions as F

from factlane.llm import pivot_search as ps


def plain(rows, k=5):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in valid:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in valid if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(set(out))


def found(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = df.select(F.col("vec_id").alias("id"), ps.quantised(F.col("embedding")).alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ps.search(v, v.where("id % 50 = 0")).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, monkeypatch, seed):
    # many cells, several blocks in each
    for name, value in (("PER_RING", 20), ("BLOCK", 16), ("QUERY_BLOCK", 4), ("FIRST_LOOK", 30), ("SAMPLE", 200)):
        monkeypatch.setattr(ps, name, value)
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(centres)]) for i in range(900)]
    same = [0.5, -0.25, 1.0, 0.0, 0.0, 2.0]
    rows += [(1000 + i, same) for i in range(300)]
    rows += [(2000, None), (2001, [None, 1.0]), (2050, [float("nan")] * 6), (2100, [float("inf")] + [0.0] * 5), (None, same), (2150, [0.0] * 6), (2200, [3.0, 1.0])]
    assert found(spark, rows) == plain([(i, v if v is None else v + [0.0] * (6 - len(v)) if None not in v else v) for i, v in rows])


def test_few_vectors_and_none(spark):
    assert found(spark, [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [2.0, 0.5])]) == plain([(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [2.0, 0.5])])
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_repeated_rows_inside_a_group_of_copies(spark):
    x, y = [1.0, 2.0], [0.5, 0.5]
    rows = [(50, x), (50, x), *[(i, x) for i in range(51, 56)], (100, y), (101, y)]
    assert found(spark, rows) == plain(rows)
    # every row doubled, and one row more often than there are hits
    rows = [(i, v) for v, first in ((x, 0), (y, 40), ([2.0, -1.0], 97)) for i in range(first, first + 12)] * 2 + [(3, x)] * 9
    assert found(spark, rows) == plain(rows)


def test_bounds_hold():
    import numpy as np

    g = np.random.default_rng(0)
    x = g.normal(size=(400, 5)) * 50
    longest = (x * x).sum(axis=1).max()
    index = ps.Index(np.zeros((0, 6)), longest, 5, 10.0, 6)
    index.pivots = ps.choose_pivots(index.lifted(x[:50]), 7)
    cell, distance = index.cells(x)
    cells = np.unique(cell)
    low, high = (np.array([f(distance[cell == c]) for c in cells]) for f in (np.min, np.max))
    queries = x[::20]
    bounds = index.bounds(queries, cells, low, high)
    scores = queries @ x.T
    for i, q in enumerate(queries):
        for j, c in enumerate(cells):
            assert bounds[i, j] <= index.reach(q[None], scores[i, cell == c].max()[None])[0] + 1e-6
