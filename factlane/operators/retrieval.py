"""Top-k documents per query by cosine, or by cosine and boosts, over the block-max index.

A task holds ranges of documents (see ``ranges``).  For a block of similar queries it works out the bound of every part of
a range in one product, scores each query's most promising part, and then only those whose bound reaches the query's
k-th score.  The k best of those first parts, over all tasks, are found in a job of their own: from then on every task
starts with the k-th scores that the whole index gives.  Products are of single precision; what may reach a k-th score, their
errors counted, is scored again in double precision.

Queries go to all tasks while their measured bytes fit; beyond that packs of queries meet tiles of ranges, each of bounded
bytes, joined by the tile's number: a pack is copied once per tile, a tile is not copied.  Exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from factlane.operators.ranges import LEADING, Queries, QueryBlock, Range, build_ranges
from factlane.scale import durable, shared

QUERY_BYTES = 64 * 1024 * 1024
TILE_BYTES = 32 * 1024 * 1024
PACK_BYTES = 16 * 1024 * 1024
#: Queries of a dense block, and numbers of its matrix.
STEP_QUERIES, CELLS = 16384, 1 << 22
#: So many ranges are bounded at once.
RANGES_TOGETHER = 64
DIGITS = 9
#: Scores rounded to single precision differ by less.
ROUNDED = 1e-6

HITS = "qid long, doc_id long, score double, cosine double, boost double"
TOTALS = "qid long, n_docs long, sum_score double, max_score double"
WORK = "qid long, n_ranges long, n_scored long"


@dataclass(frozen=True)
class Scoring:
    """How many documents are kept, from which score on, and what cosine and boost count where a document is favoured."""

    top_k: int = 3
    min_score: float = 0.1
    cosine_share: float = 1.0
    boost_share: float = 0.0


class Search:
    """The k best documents of a block of queries so far; equal scores go by doc_id, a document without one last.

    Scores are worked out in single precision first; those that may reach a query's k-th one, by the bound of what that
    leaves out, are worked out in double precision.
    """

    def __init__(self, block: QueryBlock, scoring: Scoring, floors: np.ndarray | None, counting: bool = False):
        self.block, self.scoring, self.started = block, scoring, floors is not None
        n = len(block.qid)
        self.floor = np.full(n, scoring.min_score) if floors is None else np.maximum(floors, scoring.min_score)
        self.looked: dict[int, np.ndarray] | None = {} if counting else None
        self.kept = {c: np.zeros((n, scoring.top_k)) for c in ("cosine", "boost")}
        self.kept |= {"score": np.full((n, scoring.top_k), -np.inf), "doc_id": np.zeros((n, scoring.top_k), np.int64)}
        self.kept["nameless"] = np.zeros((n, scoring.top_k), bool)
        self.share = block.cosine_share.astype(np.float32)
        self.most = block.cosine_share.max(initial=0.0)

    def add(self, of: Range, part: int, rows: np.ndarray) -> None:
        """Score a part of a range for some of the queries."""
        if not len(rows):
            return
        if self.looked is not None:
            self.looked.setdefault(id(of), np.zeros(len(self.floor), bool))[rows] = True
        block, k = self.block, self.scoring.top_k
        dense = of.dense(block, part)
        near = (block.single if len(rows) == len(block.qid) else block.single[rows]) @ dense.astype(np.float32)
        near *= self.share[rows, None]
        slack = self.most * block.blur * of.length + ROUNDED
        boost = of.boost(block, rows, part)
        if boost is not None:
            given = block.boost_share[rows, None] * boost
            near += given.astype(np.float32)
            slack += ROUNDED * given.max(initial=0.0)
        at = np.flatnonzero(near >= (self.floor[rows] - slack)[:, None].astype(np.float32))
        if not len(at):
            return
        r, d = np.divmod(at, near.shape[1])
        many = np.flatnonzero(np.bincount(r) > k)
        if len(many):
            # of a part's documents only those near its own k-th one can be among the k best
            least = np.full(len(rows), -np.inf)
            least[many] = np.partition(near[many], -k, axis=1)[:, -k] - 2 * slack
            close = near[r, d] >= least[r]
            r, d = r[close], d[close]
        across = np.ascontiguousarray(dense.T)
        step = max(1, CELLS // max(1, len(block.terms)))
        cosine = np.concatenate([
            np.einsum("ij,ij->i", block.matrix[rows[r[at:at + step]]], across[d[at:at + step]]) for at in range(0, len(r), step)
        ])
        given = boost[r, d] if boost is not None else np.zeros(len(r))
        at = rows[r]
        score = np.round(block.cosine_share[at] * cosine + block.boost_share[at] * given, DIGITS)
        reached = score >= self.floor[at]
        if reached.any():
            ids, nameless = of.doc_ids[of.cuts[part] + d[reached]], np.zeros(reached.sum(), bool)
            if ids.dtype != np.int64:
                nameless = pd.isna(ids)
                ids = np.where(nameless, 0, ids).astype(np.int64)
            self._keep(at[reached], {
                "score": score[reached], "cosine": cosine[reached], "boost": given[reached], "doc_id": ids, "nameless": nameless,
            })

    def _keep(self, at: np.ndarray, found: dict[str, np.ndarray]) -> None:
        k = self.scoring.top_k
        rows = np.flatnonzero(np.bincount(at, minlength=len(self.floor)))
        place = np.concatenate([np.repeat(np.arange(len(rows)), k), np.searchsorted(rows, at)])
        both = {c: np.concatenate([v[rows].ravel(), found[c]]) for c, v in self.kept.items()}
        order = np.lexsort((both["doc_id"], both["nameless"], -both["score"], place))
        sorted_ = place[order]
        best = order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]
        for c, v in self.kept.items():
            v[rows] = both[c][best].reshape(len(rows), k)
        self.floor[rows] = np.maximum(self.floor[rows], self.kept["score"][rows, -1])

    def run(self, ranges: list[Range], first_only: bool) -> None:
        """Score the parts of ``ranges`` whose bounds reach, or, as a first look, only the one that promises most to each query."""
        if first_only:
            most, promising, parts = np.full(len(self.floor), -np.inf, np.float32), np.zeros(len(self.floor), np.int64), []
            for at in range(0, len(ranges), RANGES_TOGETHER):
                there, bounds = self._bounds(ranges[at:at + RANGES_TOGETHER])
                best = bounds.max(axis=0)
                higher = np.flatnonzero(best > most)
                most[higher], promising[higher] = best[higher], len(parts) + bounds[:, higher].argmax(axis=0)
                parts += there
            self._look_first(parts, np.where(most >= self.floor, promising, -1))
            return
        for at in range(0, len(ranges), RANGES_TOGETHER):
            there, bounds = self._bounds(ranges[at:at + RANGES_TOGETHER])
            if not self.started:
                self._look_first(there, np.where(bounds.max(axis=0) >= self.floor, promising := bounds.argmax(axis=0), -1))
            for i in np.argsort(-bounds.max(axis=1)).tolist():
                reaching = bounds[i] >= self.floor
                self.add(*there[i], np.flatnonzero(reaching if self.started else reaching & (promising != i)))

    def _look_first(self, parts: list[tuple[Range, int]], promising: np.ndarray) -> None:
        order = np.argsort(promising, kind="stable")
        first = np.flatnonzero(np.diff(promising[order], prepend=-1))
        for rows in np.split(order, first)[1:]:
            self.add(*parts[promising[rows[0]]], np.sort(rows))

    def _bounds(self, ranges: list[Range]) -> tuple[list[tuple[Range, int]], np.ndarray]:
        """The parts of the ranges, and parts x queries: a score that no document of the part exceeds."""
        block = self.block
        tops = np.concatenate([r.top(block) for r in ranges])
        bounds = tops.astype(np.float32) @ block.single.T
        bounds *= self.share
        slack = self.most * block.blur * np.sqrt((tops * tops).sum(axis=1).max()) + ROUNDED
        highest, at = 0.0, 0
        for r in ranges:
            boosts = r.most_boosts(block)
            if boosts is not None:
                given = block.boost_share * boosts[:, block.list_of]
                bounds[at:at + len(given)] += given.astype(np.float32)
                highest = max(highest, given.max())
            at += len(r.tops)
        bounds += np.float32(slack + ROUNDED * highest)
        return [(r, i) for r in ranges for i in range(len(r.tops))], bounds

    def found(self) -> dict[str, np.ndarray]:
        """The rows that were kept, ``at`` the block's queries."""
        at, place = np.nonzero(self.kept["score"] > -np.inf)
        return {"at": at} | {c: v[at, place] for c, v in self.kept.items()}


def _best(block: QueryBlock, ranges: list[Range], scoring: Scoring, floors=None) -> pd.DataFrame:
    search = Search(block, scoring, floors)
    search.run(ranges, first_only=False)
    found = search.found()
    ids = pd.array(found["doc_id"], "Int64")
    ids[found["nameless"]] = pd.NA
    return pd.DataFrame({"qid": block.qid[found["at"]], "doc_id": ids, **{c: found[c] for c in ("score", "cosine", "boost")}})


def _work(block: QueryBlock, ranges: list[Range], scoring: Scoring, floors=None) -> pd.DataFrame:
    """How many ranges there are for each query, and how many were scored."""
    search = Search(block, scoring, floors, counting=True)
    search.run(ranges, first_only=False)
    return pd.DataFrame({"qid": block.qid, "n_ranges": len(ranges), "n_scored": sum(search.looked.values(), np.zeros(len(block.qid), np.int64))})


def _totals(block: QueryBlock, ranges: list[Range], scoring: Scoring, floors=None) -> pd.DataFrame:
    """Number, sum and maximum of the cosines at or above the threshold, per query; of all documents, so no range is left out."""
    n, total, top = np.zeros(len(block.qid), np.int64), np.zeros(len(block.qid)), np.full(len(block.qid), -np.inf)
    for r, part in ((r, i) for r in ranges for i in range(len(r.tops))):
        score = np.round(block.matrix @ r.dense(block, part), DIGITS)
        counted = score >= scoring.min_score
        n += counted.sum(axis=1)
        total += np.where(counted, score, 0.0).sum(axis=1)
        top = np.maximum(top, score.max(axis=1))
    return pd.DataFrame({"qid": block.qid, "n_docs": n, "sum_score": total, "max_score": top})


def _over_blocks(queries: Queries, ranges: list[Range], scoring: Scoring, kind, floors: np.ndarray | None) -> Iterator[pd.DataFrame]:
    at = 0
    for block in queries.blocks(STEP_QUERIES, CELLS, scoring.cosine_share, scoring.boost_share):
        yield kind(block, ranges, scoring, None if floors is None else floors[at:at + len(block.qid)])
        at += len(block.qid)


def _first_look(queries: Queries, ranges: list[Range], scoring: Scoring) -> np.ndarray:
    """queries x top_k: the best scores of the ranges that promise most."""
    made = []
    for block in queries.blocks(STEP_QUERIES, CELLS, scoring.cosine_share, scoring.boost_share):
        search = Search(block, scoring, None)
        search.run(ranges, first_only=True)
        made.append(search.kept["score"])
    return np.concatenate(made)


def _ranges_of(rows: pd.DataFrame) -> list[Range]:
    return [Range(row) for row in rows.itertuples()]


def _query_bytes() -> Column:
    return 64 + 12 * F.size("terms")


def _range_bytes() -> Column:
    return 64 + 12 * F.size("weights") + 16 * F.size("terms") + 8 * F.size("doc_ids")


def _packed(rows: DataFrame, most_bytes: int) -> DataFrame:
    """(pack, data): neighbouring rows as one Arrow stream; a pack ends past ``most_bytes``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack", "data"])

        for batch in batches:
            step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                held.append(batch.slice(at, step))
                size += held[-1].nbytes
                if size >= most_bytes:
                    yield made()
                    number, held, size = number + 1, [], 0
        if held:
            yield made()

    return rows.mapInArrow(pack, "pack long, data binary")


def _query_packs(written: DataFrame, size) -> DataFrame:
    """The queries in packs of about PACK_BYTES, those that ask for the same values and lead with the same terms beside each other.

    Queries that stand together use few terms, and the same ranges promise much to them.
    """
    asked = [F.to_json(F.array_sort("asked")).alias("asked")] if "asked" in written.columns else []
    heaviest = F.slice(F.sort_array(F.arrays_zip("weights", "terms"), asc=False), 1, LEADING)
    order = [*(["asked"] if asked else []), "_lead", "qid"]
    led = written.select("qid", "terms", "weights", *asked, F.transform(heaviest, lambda x: x["terms"]).alias("_lead"))
    cores = min(written.sparkSession.sparkContext.defaultParallelism, size["rows"] // 1024)
    n = max(1, cores, -(-size["bytes"] // PACK_BYTES))
    placed = led.repartitionByRange(n, *order) if n > 1 else led.coalesce(1)
    return durable(_packed(placed.sortWithinPartitions(*order).drop("_lead"), 2 * PACK_BYTES))


def _in_tiles(packs: DataFrame, ranges: DataFrame, scoring: Scoring, function, schema: str, floors: bool) -> DataFrame:
    """Scores each pack of queries against each tile of ranges, of about TILE_BYTES.

    The first look into each tile gives k scores a query; the best of them, over all tiles, are where the search starts.
    """
    bytes_ = ranges.agg(F.coalesce(F.sum(_range_bytes()), F.lit(0))).first()[0]
    n = max(1, -(-bytes_ // TILE_BYTES))
    tiles = durable(_packed(ranges.repartition(n), 2 * TILE_BYTES)).select(F.col("pack").alias("number"), F.col("data").alias("tile"))
    # a number for each TILE_BYTES of the index
    numbers = F.explode(F.lit([row["number"] for row in tiles.select("number").collect()]).cast("array<bigint>"))

    def scored(asked: DataFrame, look, columns: str) -> DataFrame:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    there = _ranges_of(pa.ipc.open_stream(row["tile"].as_buffer()).read_pandas())
                    known = np.frombuffer(row["floors"].as_buffer()) if "floors" in row else None
                    for made in look(row["pack"].as_py(), Queries(row["data"].as_buffer()), there, known):
                        yield pa.RecordBatch.from_pandas(made, schema=arrow_schema, preserve_index=False)

        arrow_schema = to_arrow_schema(StructType.fromDDL(columns))
        # each row is a pack beside a tile; packs are copied for each tile, tiles go through the shuffle once
        return asked.withColumn("number", numbers).join(tiles.hint("shuffle_hash"), "number").mapInArrow(score, columns)

    def whole(_, queries, there, known):
        return _over_blocks(queries, there, scoring, function, known)

    if not floors:
        return scored(packs, whole, schema)
    k = scoring.top_k

    def first(pack, queries, there, _):
        yield pd.DataFrame({"pack": [pack], "best": [_first_look(queries, there, scoring).tobytes()]})

    def kth(looks: pd.DataFrame) -> pd.DataFrame:
        best = None
        for look in looks["best"]:
            found = np.frombuffer(look).reshape(-1, k)
            both = found if best is None else np.concatenate([best, found], axis=1)
            best = -np.partition(-both, k - 1, axis=1)[:, :k] if both.shape[1] > k else both
        return pd.DataFrame({"of": looks["pack"][:1], "floors": [best.min(axis=1).tobytes()]})

    looked = durable(scored(packs, first, "pack long, best binary").groupBy("pack").applyInPandas(kth, "of long, floors binary"))
    known = packs.join(looked, F.col("pack") == F.col("of")).drop("of")
    return scored(known, whole, schema)


def _run(queries: DataFrame, documents: DataFrame, scoring: Scoring, function, schema: str, broadcast: bool | None, floors: bool) -> DataFrame:
    ranges = documents if "doc_ids" in documents.columns else build_ranges(documents.select("doc_id", "terms", "weights"))
    written = durable(queries.select("qid", "terms", "weights", *[c for c in queries.columns if c == "asked"]))
    size = written.agg(
        F.count("*").alias("rows"), F.countDistinct("qid").alias("ids"), F.coalesce(F.sum(_query_bytes()), F.lit(0)).alias("bytes")
    ).first()
    if size["rows"] != size["ids"]:
        raise ValueError("qid must be unique")
    if broadcast is None:
        broadcast = size["bytes"] <= QUERY_BYTES
    packs = _query_packs(written, size)
    if not broadcast:
        return _in_tiles(packs, ranges, scoring, function, schema, floors)
    spark = documents.sparkSession
    # the sparse vectors, measured above; each task makes dense blocks of them
    sent = shared(spark, [bytes(row["data"]) for row in packs.orderBy("pack").collect()])

    def scored(look, columns: str, known=None) -> DataFrame:
        def score_partition(batches):
            for batch in batches:
                there = _ranges_of(batch)
                for number, data in enumerate(sent.value if there else ()):
                    yield from look(number, Queries(data), there, known and known.value[number])

        return ranges.mapInPandas(score_partition, columns)

    def whole(_, asked, there, known):
        return _over_blocks(asked, there, scoring, function, known)

    if not floors:
        return scored(whole, schema)

    def first(_, asked, there, known):
        best = _first_look(asked, there, scoring)
        at, place = np.nonzero(best > -np.inf)
        yield pd.DataFrame({"qid": asked.qid[at], "score": best[at, place]})

    # a number per query, of queries whose bytes were measured
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    looked = scored(first, "qid long, score double").withColumn("place", place).where(F.col("place") == scoring.top_k)
    kth = looked.select("qid", "score").toPandas().set_index("qid")["score"]
    reached = [kth.reindex(Queries(data).qid).fillna(-np.inf).to_numpy() for data in sent.value]
    return scored(whole, schema, shared(spark, reached))


def search(queries: DataFrame, documents: DataFrame, scoring: Scoring, broadcast: bool | None = None) -> DataFrame:
    """(qid, doc_id, score, cosine, boost): the k best documents per query are among the rows.

    ``documents``: ranges, or vectors to make them of.  ``queries`` may have ``asked``, the values that favour documents.
    """
    return _run(queries, documents, scoring, _best, HITS, broadcast, floors=True)


def ranked(scored: DataFrame, scoring: Scoring) -> DataFrame:
    """The k best of each query from the threshold on, with ``rank``; equal scores go by doc_id."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return (
        scored.where(F.col("score") >= scoring.min_score)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= scoring.top_k)
    )


def top_documents(queries: DataFrame, documents: DataFrame, scoring: Scoring, broadcast: bool | None = None) -> DataFrame:
    """(qid, rank, doc_id, score) by cosine alone."""
    return ranked(search(queries.select("qid", "terms", "weights"), documents, scoring, broadcast), scoring).select(
        "qid", "rank", "doc_id", "score"
    )


def ranges_scored(queries: DataFrame, documents: DataFrame, scoring: Scoring) -> DataFrame:
    """(qid, n_ranges, n_scored): how much of the index a search looks into, the first look aside."""
    work = _run(queries, documents, scoring, _work, WORK, True, floors=True)
    return work.groupBy("qid").agg(F.sum("n_ranges").alias("n_ranges"), F.sum("n_scored").alias("n_scored"))


def score_totals(queries: DataFrame, documents: DataFrame, scoring: Scoring, broadcast: bool | None = None) -> DataFrame:
    """(qid, n_docs, sum_score, max_score) over the documents at or above the threshold."""
    partial = _run(queries, documents, scoring, _totals, TOTALS, broadcast, floors=False)
    return partial.groupBy("qid").agg(
        F.sum("n_docs").alias("n_docs"), F.sum("sum_score").alias("sum_score"), F.max("max_score").alias("max_score")
    )
