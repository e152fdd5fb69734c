"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, cut into rings.  A query
looks at rings in the order of the smallest distance that the triangle inequality
allows, and stops when no ring left can hold anything as good as its k-th best hit.

Inner products become distances by one more coordinate: with M the largest length,
a vector x gets sqrt(M^2 - |x|^2) and a query gets 0; then |q - x|^2 = |q|^2 + M^2 - 2 qx, so the
nearest vectors are those of the largest product.  Distances only decide where to look; scores are
exact products of whole numbers (below 2^53).

* Pivots are chosen from a bounded sample; every vector is indexed.
* Of equal vectors only those with the k + 1 smallest distinct ids can be among a query's k hits, and of rows that
  repeat both id and vector only k, so copies beyond those are left out of the index, however many there are; all
  vectors that are queries ask.
* A ring with many vectors is several blocks, and queries come to a ring in blocks too; the join on rings has one
  row per pair of blocks, and each such row gives a query's best k in it.
* The first round visits each query's most promising rings, which gives its k-th best score; the second visits those
  that may still hold better ones.

Nulls: vectors that are null, or hold null or non-finite components, take no part, neither do rows without an id.
Vectors shorter than the longest count as followed by zeros.  Repeated ids are separate candidates; a query skips all rows with its own id.  An
empty table, or one without queries, gives no rows; a query with fewer than k other vectors gets those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

SCALE = 256
K = 5
#: Vectors that pivots are chosen from, at most, and the most pivots and rings per pivot.
SAMPLE, MAX_PIVOTS, MAX_RINGS = 4096, 256, 256
#: Vectors in a block, and per ring about; queries in a block.
BLOCK, PER_RING, QUERY_BLOCK = 1024, 512, 256
#: Vectors that the first round looks at, at least.
FIRST_LOOK = 2048
#: Distances are rounded numbers; this share of them is allowed for.
SLACK = 1e-9


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; null if any component is null or not finite."""
    out = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(F.coalesce(wrong, F.lit(True)), None).otherwise(out)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


@dataclass
class Index:
    """What the driver and every task know of the index; its size is bounded by the most pivots and rings."""

    pivots: np.ndarray  # with the added coordinate
    longest: float  # squared
    width: int
    ring: float  # width of a ring in distance
    rings: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        p = self.pivots
        square = (lifted * lifted).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * lifted @ p.T
        return np.sqrt(np.maximum(square, 0))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell (pivot and ring as one number) of each vector, and its distance from the pivot."""
        far = self.distances(self.lifted(x))
        pivot = far.argmin(axis=1)
        distance = far[np.arange(len(x)), pivot]
        ring = np.minimum((distance / self.ring).astype(np.int64), self.rings - 1)
        return pivot * self.rings + ring, distance

    def bounds(self, queries: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each query and cell (whose distances from the pivot go from low to high) the least possible distance."""
        far = self.distances(np.column_stack([queries, np.zeros(len(queries))]))[:, cell // self.rings]
        return np.maximum(np.maximum(far - high, low - far), 0)

    def reach(self, queries: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which a vector has the score; minus infinity stands for any distance."""
        square = (queries * queries).sum(axis=1) + self.longest - 2 * score
        return np.where(np.isfinite(score), np.sqrt(np.maximum(square, 0)) * (1 + SLACK) + SLACK, np.inf)


def choose_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points far from each other: each is the one farthest from those chosen before."""
    chosen = [0]
    far = np.full(len(points), np.inf)
    while len(chosen) < min(n, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return points[chosen]


def build_index(vectors: DataFrame, n: int, longest: float, width: int) -> Index:
    """Pivots and ring width from a sample of ``vectors`` (id, x): those with the smallest hashes."""
    sampled = vectors.select("x").orderBy(F.xxhash64("x"), "id").limit(SAMPLE).toPandas()["x"]
    points = np.zeros((len(sampled), width))
    for i, x in enumerate(sampled):
        points[i, : len(x)] = x
    pivots = int(np.clip(np.sqrt(n / PER_RING), 1, MAX_PIVOTS))
    rings = int(np.clip(n / PER_RING / pivots, 1, MAX_RINGS))
    index = Index(np.zeros((0, width + 1)), longest, width, 1.0, rings)
    lifted = index.lifted(points)
    index.pivots = choose_pivots(lifted, pivots)
    nearest = np.sort(index.distances(lifted).min(axis=1))
    # rings cover the middle of the sample's distances; the last is open
    index.ring = max(float(nearest[int(0.98 * (len(nearest) - 1))]) / rings, 1e-6)
    return index


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the places of the ``k`` highest scores, ties by id, and the row of each."""
    order = np.argsort(ids, kind="stable")
    scores = np.where(ids[order] == own[:, None], -np.inf, scores[:, order])
    if scores.shape[1] > k:
        # everything from the k-th score up, then ties by place
        least = np.partition(scores, -k, axis=1)[:, -k]
        row, place = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    else:
        row, place = np.nonzero(np.isfinite(scores))
    by = np.lexsort([place, -scores[row, place], row])
    row, place = row[by], place[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], order[place[rank < k]]


def _search(width: int, k: int):
    """Rows (queries' ids and vectors, candidates' ids and vectors) -> the best of the candidates for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qid, q, ids, x = (batch.column(c).slice(i, 1).flatten() for c in range(4))
                qid, ids = qid.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
                scores = matrix(q, width) @ matrix(x, width).T
                row, at = _best(scores, ids, qid, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qid[row]), pa.array(ids[at]), pa.array(scores[row, at].astype(np.int64))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visit(plan: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """The best hits of every query in every block of the cells it visits; ``plan`` has (cell, query_id, q)."""
    asking = plan.withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("asking") / QUERY_BLOCK)))
    asking = asking.groupBy("cell", "part").agg(F.collect_list(F.struct("query_id", "q")).alias("a"))
    asking = keep(asking.select("cell", F.col("a.query_id").alias("qids"), F.col("a.q").alias("qs")), "asking")
    pairs = asking.join(blocks, "cell").select("qids", "qs", "ids", "xs")
    return pairs.mapInArrow(_search(width, k), "query_id long, vec_id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for ``queries`` (id, x) among ``vectors`` (id, x).

    ``x`` holds whole numbers as doubles (see ``quantised``), without nulls.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # of equal vectors the k + 1 smallest distinct ids, as a query skips all rows with its own; k rows of each can be hits
    same = Window.partitionBy("x").orderBy("id")
    several = vectors.groupBy("id", "x").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_rows"))
    several = several.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    several = several.select("id", "x", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_row")).drop("_row")
    several = keep(several, "distinct_vectors")
    squares = F.aggregate("x", F.lit(0.0), lambda a, b: a + b * b)
    n, longest, width = several.agg(F.count("*"), F.max(squares), F.max(F.size("x"))).first()
    width = max(width or 0, queries.agg(F.max(F.size("x"))).first()[0] or 0)
    if not n or not width:
        if not n:
            return empty
        width = 1
    index = build_index(several, n, longest or 0.0, width)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = shared.value.cells(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], names=["id", "x", "cell", "distance"])

    placed = keep(several.mapInArrow(place, "id long, x array<double>, cell long, distance double"), "placed")
    # at most MAX_PIVOTS * MAX_RINGS rows
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    cells = cells.orderBy("cell").toPandas()
    sizes = spark.createDataFrame(cells[["cell", "n"]])
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))
    blocks = placed.join(F.broadcast(sizes), "cell").groupBy("cell", block.alias("b")).agg(F.collect_list(F.struct("id", "x")).alias("v"))
    blocks = keep(blocks.select("cell", F.col("v.id").alias("ids"), F.col("v.x").alias("xs")), "rings")
    number, count = cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64)
    low, high = cells["low"].to_numpy(float), cells["high"].to_numpy(float)
    known = spark.sparkContext.broadcast((number, count, low, high))

    def first_cells(bounds: np.ndarray) -> np.ndarray:
        """The nearest cells of each query until they hold FIRST_LOOK vectors."""
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(count[order], axis=1) - count[order]
        chosen = np.zeros(bounds.shape, bool)
        np.put_along_axis(chosen, order, before < FIRST_LOOK, axis=1)
        return chosen

    def visits(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            number, count, low, high = known.value
            for whole in batches:
                for at in range(0, whole.num_rows, QUERY_BLOCK):
                    batch = whole.slice(at, QUERY_BLOCK)
                    q = matrix(batch.column(1), width)
                    bounds = index.bounds(q, number, low, high)
                    chosen = first_cells(bounds)
                    if second:
                        score = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                        score = np.where(np.isnan(score), -np.inf, score)
                        chosen = ~chosen & (bounds <= index.reach(q, score)[:, None])
                    row, cell = np.nonzero(chosen)
                    taken = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number[cell]), batch.column(0).take(taken), batch.column(1).take(taken)], names=["cell", "query_id", "q"]
                    )

        return run

    def planned(df: DataFrame, second: bool) -> DataFrame:
        plan = keep(df.mapInArrow(visits(second), "cell long, query_id long, q array<double>"), "visits")
        # at most MAX_PIVOTS * MAX_RINGS rows
        asking = plan.groupBy("cell").agg(F.count("*").alias("asking"))
        return plan.join(F.broadcast(asking), "cell")

    asked = queries.select(F.col("id").alias("query_id"), F.col("x").alias("q")).distinct()
    asked = keep(asked, "queries")
    first = keep(_top(_visit(planned(asked, False), blocks, width, k), k), "first_round")
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = planned(asked.join(kth, "query_id", "left").select("query_id", "q", "kth"), True)
    found = _visit(rest, blocks, width, k).union(first.select("query_id", "vec_id", "score"))
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
