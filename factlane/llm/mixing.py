"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources.  Documents are summed by membership
pattern (the set of their sources), so the flow network has a node per pattern
and per source, not per document:

* from the start to a pattern: one arc per repetition, each as wide as the
  pattern's words, and dearer the more often the words have been used already
  (convex costs, so nothing is repeated while fresh words are left);
* from a pattern to each of its sources, without limit;
* from a source to the end: the source's target.

The cheapest largest flow says how many words of each pattern go to each source.  All cost lies on the
first arcs, so it is found repetition by repetition: the largest flow with one pass of each pattern, extended
with two, and so on, along layers of shortest paths.  A source that shares no document needs no
flow: it gets its target or all its words as often as allowed, whichever is less.
Words times passes become documents by a seeded hash: all documents for the whole
passes, and for the last one those with the smallest hashes, up to the cell of
equal hashes that comes nearest to the amount.  That boundary is found by sums
over hash prefixes, 12 bits at a time, so nothing is sorted or ranked.

The table of patterns comes to the driver, in Arrow columns; it has a row per distinct set of
sources, which grows with the number of sources, not with the documents.

Nulls: a missing text has no words; a missing source, or a missing or empty list
of sources, is a source of its own that comes last.  A document without words is
taken zero times its zero words.  Equal ids have equal hashes and are taken alike.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep
from .text import n_words

MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Bits of a document's hash, and how many are looked at in one step.
HASH_BITS, STEP_BITS = 36, 12


def seeded_hash(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """HASH_BITS bits of the md5 of seed and id; the same in every run."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: int, times: int = MAX_REPEATS) -> list[float]:
    """Shares of ``total`` by weight, none above ``times`` its size, the excess shared again by weight."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    most, targets = times * size, np.zeros(len(size))
    full = np.zeros(len(size), bool)
    while (open_weight := weight[~full].sum()) > 0:
        share = weight * (total - most[full].sum()) / open_weight
        over = ~full & (share > most)
        if not over.any():
            targets[~full] = share[~full]
            break
        full |= over
    targets[full] = most[full]
    return targets.tolist()


@dataclass
class _Arc:
    to: int
    room: float
    back: int


class FlowNetwork:
    """Largest flow in layers: all shortest paths are filled before paths are sought anew."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, room: float) -> tuple[_Arc, _Arc]:
        """An arc and its reverse, whose room is what flows."""
        self.arcs[a].append(_Arc(b, room, len(self.arcs[b])))
        self.arcs[b].append(_Arc(a, 0.0, len(self.arcs[a]) - 1))
        return self.arcs[a][-1], self.arcs[b][-1]

    def _layers(self, start: int, least: float) -> list[int]:
        layer, waiting = [-1] * len(self.arcs), deque([start])
        layer[start] = 0
        while waiting:
            a = waiting.popleft()
            for arc in self.arcs[a]:
                if arc.room > least and layer[arc.to] < 0:
                    layer[arc.to] = layer[a] + 1
                    waiting.append(arc.to)
        return layer

    def run(self, start: int, end: int, least: float) -> None:
        """Extend what flows to the largest flow; rooms of ``least`` or less count as none."""
        while (layer := self._layers(start, least))[end] >= 0:
            tried = [0] * len(self.arcs)
            path: list[_Arc] = []
            at = start
            while True:
                if at == end:
                    room = min(arc.room for arc in path)
                    for arc in path:
                        arc.room -= room
                        self.arcs[arc.to][arc.back].room += room
                    # go back to before the first arc that is full
                    keep_ = next(i for i, arc in enumerate(path) if arc.room <= least)
                    at = self.arcs[path[keep_].to][path[keep_].back].to
                    path = path[:keep_]
                elif tried[at] < len(self.arcs[at]):
                    arc = self.arcs[at][tried[at]]
                    if arc.room > least and layer[arc.to] == layer[at] + 1:
                        path.append(arc)
                        at = arc.to
                    else:
                        tried[at] += 1
                elif path:
                    arc = path.pop()
                    at = self.arcs[arc.to][arc.back].to
                    tried[at] += 1
                else:
                    break


def route(
    patterns: list[tuple[tuple[int, ...], int]], targets: list[float], times: int = MAX_REPEATS
) -> list[dict[int, float]]:
    """For each pattern (its sources, its words): the words that each source gets from it.  No two have the same sources."""
    shared = {s for sources, _ in patterns if len(sources) > 1 for s in sources}
    out = [{} if set(sources) & shared else {s: min(targets[s], float(times * size)) for s in sources} for sources, size in patterns]
    inside = [p for p, (sources, _) in enumerate(patterns) if set(sources) & shared]
    start, end = 0, 1
    node = {s: 2 + len(inside) + i for i, s in enumerate(sorted(shared))}
    net = FlowNetwork(2 + len(inside) + len(node))
    first, to_source = [], []
    for i, p in enumerate(inside):
        first.append(net.add(start, 2 + i, 0.0)[0])
        to_source.append({s: net.add(2 + i, node[s], math.inf)[1] for s in patterns[p][0]})
    for s, at in node.items():
        net.add(at, end, targets[s])
    for _ in range(times):
        # once more through every pattern costs more than any way to use the passes before
        for arc, p in zip(first, inside):
            arc.room += float(patterns[p][1])
        net.run(start, end, least=1e-6)
    for i, p in enumerate(inside):
        out[p] = {s: arc.room for s, arc in to_source[i].items()}
    return out


def _last_pass(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per pattern, the hash below which documents make up ``wanted`` words (``pattern``, ``words``)."""
    state = wanted.select("pattern", F.col("words").alias("left"), F.lit(0).cast("long").alias("prefix"))
    for step in range(1, HASH_BITS // STEP_BITS + 1):
        shift = HASH_BITS - step * STEP_BITS
        inside = docs.join(F.broadcast(state.select("pattern", "left", "prefix")), "pattern").where(
            F.shiftright("hash", shift + STEP_BITS) == F.col("prefix")
        )
        cells = inside.groupBy("pattern", "left", F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("size"))
        before = Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        # the last cell that starts below what is left: at most 2^STEP_BITS cells stand in one pattern
        state = cells.where(F.col("before") < F.col("left")).groupBy("pattern").agg(
            F.max_by(F.struct("cell", (F.col("left") - F.col("before")).alias("left"), "size"), "cell").alias("c")
        )
        state = keep(state.select("pattern", "c.left", F.col("c.cell").alias("prefix"), "c.size"), "boundary")
    above = F.col("prefix") + F.when(F.col("left") > F.col("size") / 2, 1).otherwise(0)
    return state.select("pattern", above.alias("below"))


def mix(
    docs: DataFrame,
    size: Column | None = None,
    sources: Column | None = None,
    weights: dict[str, float] | None = None,
    times: int = MAX_REPEATS,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``membership`` (list of sources), ``copies`` and ``taken`` (size times copies).

    ``sources`` is an array of source names (default: the one in ``source``).
    ``weights`` by source; without it, sources by code point weigh 5, 2, 1 and so on.
    Targets share all words of the documents by weight, at most ``times`` a
    source's own words each.  The result also has ``source_size`` and ``target`` of
    the document's first source.  Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    size = n_words("text") if size is None else size
    names = F.array(F.col("source")) if sources is None else sources
    names = F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))))
    names = F.when(F.size(names) == 0, F.array(F.lit(None).cast("string"))).otherwise(names)
    added = {"size", "membership", "copies", "taken", "source_size", "target"}
    own = [c for c in docs.columns if c.lower() not in added]
    # the caller's columns travel in a struct, so that none clashes with those used here
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_own"),
        size.alias("size"), names.alias("membership"), seeded_hash(seed=seed).alias("_hash"),
    )
    # null-safe on arrays that may hold nulls: patterns are joined by their text
    rows = keep(rows.withColumn("_pattern", F.to_json("membership")), "mix_rows")
    # a row per distinct set of sources
    table = rows.groupBy("membership").agg(F.sum("size").alias("words")).toArrow()
    summed = [(tuple(m), int(w or 0)) for m, w in zip(table.column("membership").to_pylist(), table.column("words").to_pylist())]
    code_points = lambda x: (x is None, x or "")
    summed.sort(key=lambda r: [code_points(x) for x in r[0]])
    order = sorted({x for members, _ in summed for x in members}, key=code_points)
    number = {x: i for i, x in enumerate(order)}
    patterns = [(tuple(number[x] for x in members), words) for members, words in summed]
    source_words = [0] * len(order)
    for members, words in patterns:
        for i in members:
            source_words[i] += words
    if weights is None:
        source_weights: list[float] = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))]
    else:
        source_weights = [weights.get(x, 0) for x in order]
    targets = water_fill(source_words, source_weights, sum(words for _, words in patterns), times)
    flow = route(patterns, targets, times)
    plan = []
    for p, (sources_, words) in enumerate(patterns):
        used = min(sum(flow[p].values()), float(times * words))
        full = min(int(used // words), times) if words else 0
        first = sources_[0]
        plan.append((p, list(summed[p][0]), full, used - full * words, source_words[first], targets[first]))
    table = spark.createDataFrame(
        plan, "pattern int, membership array<string>, full int, words double, source_size long, target double"
    )
    table = table.withColumn("_pattern", F.to_json("membership")).drop("membership")
    light = rows.join(F.broadcast(table.select("_pattern", "pattern")), "_pattern")
    light = light.select("pattern", F.col("_hash").alias("hash"), "size")
    below = _last_pass(light, table.select("pattern", "words"))
    table = keep(table.join(below, "pattern", "left"), "mix_plan")
    copies = F.col("full") + F.when(F.col("_hash") < F.col("below"), 1).otherwise(0)
    out = rows.join(F.broadcast(table), "_pattern").withColumn("copies", F.least(copies, F.lit(times)))
    return out.select(
        "_own.*", "size", "membership", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns only."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(row.alias("_row"), "doc_id", "source", n_words("text").alias("_words"))
    mixed = mix(sized, size=F.col("_words")).select("_row", "copies")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")).select("_row.*")
