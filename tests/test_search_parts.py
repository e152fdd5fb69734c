import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from factlane.operators import ranges, retrieval
from factlane.operators.retrieval import Scoring, ranked, search


def unit(weights):
    weights = np.array(weights, float)
    return weights / np.sqrt((weights * weights).sum())


def vectors(rng, n):
    """Sixteen neighbours share their heaviest term; all share term 0."""
    return pd.DataFrame([
        {"doc_id": i, "terms": np.array([0, 1 + i // 16, 100 + rng.randrange(5)], np.int32), "weights": unit([1, 3 + rng.random(), rng.random()])}
        for i in range(n)
    ])


def packed_queries(rows):
    table = pa.table({
        "qid": pa.array([r[0] for r in rows], pa.int64()), "terms": pa.array([r[1] for r in rows], pa.list_(pa.int32())),
        "weights": pa.array([r[2] for r in rows], pa.list_(pa.float64())), "asked": pa.array([r[3] for r in rows], pa.string()),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return ranges.Queries(sink.getvalue().to_pybytes())


def test_parts_of_a_range_are_left_out(monkeypatch):
    rng = random.Random(3)
    docs = vectors(rng, 256)
    rows = [ranges._range_row(n, docs.iloc[64 * n:64 * n + 64]) for n in range(4)]
    marks = {3: [("nX", 5, 0.8), ("nX", 5, 0.6), ("cY", 5, 0.5), ("cY", 20, 0.5)]}
    for n, row in enumerate(rows):
        row |= {name: [m[i] for m in marks.get(n, [])] for i, name in enumerate(ranges.MARKS)}
    index = [ranges.Range(row) for row in pd.DataFrame(rows).itertuples()]
    asked = [(q, [0, 1 + q % 16, 100], unit([1, 2, 0.5]), ["[]", '["cY","nX"]', '["cY"]'][q % 3]) for q in range(60)]
    scored = []
    dense = ranges.Range.dense
    monkeypatch.setattr(ranges.Range, "dense", lambda self, block, part: scored.append(part) or dense(self, block, part))
    scoring = Scoring(3, 0.1, 0.3, 0.7)
    found = []
    for query in asked:
        for block in packed_queries([query]).blocks(16, 1 << 10, scoring.cosine_share, scoring.boost_share):
            found.append(retrieval._best(block, index, scoring))
    assert len(scored) < 0.4 * len(asked) * 16  # of 16 parts; a range was scored whole before
    together = pd.concat(retrieval._over_blocks(packed_queries(asked), index, scoring, retrieval._best, None))
    for got in (pd.concat(found), together):
        got = got.sort_values(["qid", "score", "doc_id"], ascending=[True, False, True])
        for qid, terms, weights, values in asked:
            query = dict(zip(terms, weights))
            expected = []
            for doc_id, doc_terms, doc_weights in docs.itertuples(index=False):
                cosine = sum(query.get(t, 0) * w for t, w in zip(doc_terms.tolist(), doc_weights))
                here = [(v, w) for v, p, w in marks[3] if f'"{v}"' in values and doc_id == 192 + p]
                boost = sum(max(w for v, w in here if v == value) for value in {v for v, _ in here})
                score = cosine if values == "[]" else 0.3 * cosine + 0.7 * boost
                expected.append((-round(score, 9), doc_id))
            best = sorted(e for e in expected if -e[0] >= scoring.min_score)[:3]
            hits = got[got["qid"] == qid]
            assert hits["doc_id"].tolist() == [d for _, d in best]
            assert hits["score"].tolist() == pytest.approx([-s for s, _ in best])


def test_tiles_are_not_copied(spark, monkeypatch):
    """Queries and ranges too many to send: queries meet tiles in a join, without a copy of a tile for each pack."""
    monkeypatch.setattr(retrieval, "TILE_BYTES", 20_000)
    monkeypatch.setattr(retrieval, "PACK_BYTES", 4_000)
    rng = random.Random(4)
    docs = vectors(rng, 300)
    rows = [(int(r.doc_id) if r.doc_id != 7 else None, r.terms.tolist(), r.weights.tolist()) for r in docs.itertuples()]
    documents = spark.createDataFrame(rows, "doc_id long, terms array<int>, weights array<double>")
    asked = [(q, [0, 1 + q % 19, 100], unit([1, 2, 0.5]).tolist()) for q in range(200)] + [(900, [], [])]
    queries = spark.createDataFrame(asked, "qid long, terms array<int>, weights array<double>")
    scoring = Scoring(3, 0.1)
    tiled = search(queries, documents, scoring, broadcast=False)
    plan = tiled._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "CartesianProduct" not in plan
    listed = lambda hits: Counter((r.qid, r["rank"], r.doc_id, r.score) for r in ranked(hits, scoring).collect())
    assert listed(tiled) == listed(search(queries, documents, scoring, broadcast=True))
    assert len(listed(tiled)) == 600
