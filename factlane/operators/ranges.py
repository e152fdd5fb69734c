"""The block-max index: documents in ranges, each with its postings and what its documents can reach at most.

A range holds RANGE_DOCUMENTS documents that lead with the same terms.  Beside its postings, ordered by term, it
has the largest weight of each term in it.  The product of a query with those largest weights is a bound
for the query's cosine with every document of the range, so a range whose bound is below the k-th score a query
already has is never scored for it.

For searches with favoured documents a range also has marks: which asked values favour which of its documents, and by how
much.  Their largest weights bound the boost in the same way, so ranges fall into tiers by boost: once k documents
of a high tier are found, lower tiers can't reach them by cosine and are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlane.scale import durable

RANGE_DOCUMENTS = 64
#: So many of a range's documents are bounded and scored together.
PART_DOCUMENTS = 16
#: So many ranges a task makes before it passes them on.
RANGES_AT_ONCE = 16
#: Leading terms by which documents are put beside each other.
LEADING = 3
COLUMNS = """range long, doc_ids array<long>, terms array<int>, tops array<double>, ends array<int>, places array<int>,
    weights array<double>"""
MARKS = ["mark_values", "mark_places", "mark_weights"]


def _flat(lists, kind) -> np.ndarray:
    return np.concatenate([np.asarray(x, dtype=kind) for x in lists] or [np.empty(0, kind)])


def _range_row(number: int, rows: pd.DataFrame) -> dict:
    terms, weights = _flat(rows["terms"], np.int64), _flat(rows["weights"], float)
    places = np.repeat(np.arange(len(rows)), rows["terms"].map(len).to_numpy())
    order = np.lexsort((places, terms))
    terms, weights, places = terms[order], weights[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.empty(0, np.int64)
    return {
        "range": number, "doc_ids": rows["doc_id"].to_numpy(), "terms": terms[first],
        "tops": np.maximum.reduceat(weights, first) if len(first) else weights,
        "ends": np.append(first[1:], len(terms)) if len(first) else first, "places": places, "weights": weights,
    }


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch])
        whole = len(rows) - len(rows) % RANGE_DOCUMENTS
        starts = range(0, whole, RANGE_DOCUMENTS)
        for at in range(0, len(starts), RANGES_AT_ONCE):
            made = [_range_row(number + s // RANGE_DOCUMENTS, rows.iloc[s:s + RANGE_DOCUMENTS]) for s in starts[at:at + RANGES_AT_ONCE]]
            yield pd.DataFrame(made)
        number += len(starts)
        rest = rows.iloc[whole:]
        # copies, as views would keep the whole batch
        rest = rest.assign(terms=rest["terms"].map(np.copy), weights=rest["weights"].map(np.copy))
    if rest is not None and len(rest):
        yield pd.DataFrame([_range_row(number, rest)])


def ranges_of(vectors: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """The ranges of ``vectors`` (doc_id, terms, weights).

    Documents are sorted by the columns ``beside`` and their leading terms; one shuffle, which a
    term that leads most documents doesn't skew, since doc_id cuts it too.
    """
    heaviest = F.slice(F.sort_array(F.arrays_zip("weights", "terms"), asc=False), 1, LEADING)
    order = [*beside, "_lead", "doc_id"]
    led = vectors.withColumn("_lead", F.transform(heaviest, lambda x: x["terms"])).select(*order, "terms", "weights")
    placed = led.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "terms", "weights")
    return placed.mapInPandas(_ranges, COLUMNS)


def build_ranges(vectors: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """The ranges, written once."""
    return durable(ranges_of(vectors, beside), all_cores=True)


def with_marks(ranges: DataFrame, favoured: DataFrame) -> DataFrame:
    """``ranges`` with the marks of ``favoured`` (value, doc_id, weight), written once.

    A range's marks are bounded by the asked values that favour one of its documents.
    """
    places = ranges.select("range", F.posexplode("doc_ids").alias("place", "doc_id"))
    marks = favoured.join(places, "doc_id").groupBy("range").agg(F.collect_list(F.struct("value", "place", "weight")).alias("m"))
    lists = [F.col(f"m.{c}").alias(name) for c, name in zip(("value", "place", "weight"), MARKS)]
    kinds = ("array<string>", "array<int>", "array<double>")
    joined = ranges.join(marks.select("range", *lists), "range", "left")
    filled = [F.coalesce(name, F.array().cast(kind)).alias(name) for name, kind in zip(MARKS, kinds)]
    return durable(joined.select(*ranges.columns, *filled), all_cores=True)


class Queries:
    """The queries of a pack: their sparse vectors, and the distinct lists of asked values."""

    def __init__(self, data: bytes):
        rows = pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()
        flat = lambda name: pc.list_flatten(rows[name]).combine_chunks().to_numpy(zero_copy_only=False)
        self.qid = rows["qid"].to_numpy()
        self.ends = np.append(0, np.cumsum(pc.list_value_length(rows["terms"]).fill_null(0).to_numpy()))
        self.terms, self.weights = flat("terms").astype(np.int64), flat("weights").astype(float)
        if "asked" in rows.column_names:
            asked = rows["asked"].combine_chunks().dictionary_encode()
            self.list_of, self.lists = asked.indices.to_numpy(), [json.loads(x) for x in asked.dictionary.to_pylist()]
        else:
            self.list_of, self.lists = np.zeros(len(self.qid), np.int64), [[]]

    def blocks(self, rows: int, cells: int, cosine_share: float, boost_share: float) -> Iterator[QueryBlock]:
        """Neighbouring queries, ``rows`` at most, whose dense matrix has ``cells`` at most or one row."""
        starts = [(at, min(at + rows, len(self.qid))) for at in range(0, len(self.qid), rows)][::-1]
        while starts:
            first, last = starts.pop()
            terms = np.flatnonzero(np.bincount(self.terms[self.ends[first]:self.ends[last]]))
            if (last - first) * len(terms) > cells and last - first > 1:
                middle = (first + last) // 2
                starts += [(middle, last), (first, middle)]
            else:
                yield QueryBlock(self, first, last, terms, cosine_share, boost_share)


class QueryBlock:
    """Queries as a dense matrix over just the terms they use, and who asks for which values."""

    def __init__(self, of: Queries, first: int, last: int, terms: np.ndarray, cosine_share: float, boost_share: float):
        self.qid, self.terms = of.qid[first:last], terms
        ends = of.ends[first:last + 1]
        held = slice(ends[0], ends[-1])
        row = np.repeat(np.arange(last - first), np.diff(ends))
        self.matrix = np.zeros((last - first, len(terms)))
        self.matrix[row, np.searchsorted(terms, of.terms[held])] = of.weights[held]
        self.single = self.matrix.astype(np.float32)
        #: The longest query vector, and by how much products in single precision may differ, for vectors of length one.
        self.length = np.sqrt(np.bincount(row, of.weights[held] ** 2, 1)).max()
        self.blur = 2.0 ** -23 * (np.diff(ends).max(initial=0) + 16) * self.length
        # queries that ask for the same values have the same boosts
        lists, self.list_of = np.unique(of.list_of[first:last], return_inverse=True)
        self.lists = [of.lists[i] for i in lists.tolist()]
        asking: dict[str, list[int]] = {}
        for i, values in enumerate(self.lists):
            for value in set(values):
                asking.setdefault(value, []).append(i)
        self.asking = {value: np.array(at) for value, at in asking.items()}
        # a query that favours no document goes by cosine alone
        favours = np.array([len(values) > 0 for values in self.lists], bool)[self.list_of]
        self.cosine_share = np.where(favours, cosine_share, 1.0)
        self.boost_share = np.where(favours, boost_share, 0.0)


class Range:
    """One row of the index in a task, bounded and scored in parts of PART_DOCUMENTS.

    Documents that lead with the same terms stand together inside a range as well, so parts have far lower bounds than it has.
    """

    def __init__(self, row):
        self.doc_ids, self.terms = np.asarray(row.doc_ids), np.asarray(row.terms)
        places, weights = np.asarray(row.places), np.asarray(row.weights, float)
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(np.asarray(row.ends), prepend=0))
        #: The longest of its documents' vectors.
        self.length = np.sqrt(np.bincount(places, weights ** 2, 1)).max()
        self.cuts = [*range(0, len(self.doc_ids), PART_DOCUMENTS), len(self.doc_ids)]
        part = places // PART_DOCUMENTS
        self.tops = np.zeros((len(self.cuts) - 1, len(self.terms)))
        np.maximum.at(self.tops, (part, term), weights)
        of_part = [np.flatnonzero(part == i) for i in range(len(self.tops))]
        self.parts = [(term[at], (places[at] % PART_DOCUMENTS).astype(np.int16), weights[at]) for at in of_part]
        #: For each value that favours one of its documents: each document's weight.
        self.marks: dict[str, np.ndarray] = {}
        if hasattr(row, "mark_values"):
            for value, place, weight in zip(row.mark_values, row.mark_places, row.mark_weights):
                given = self.marks.setdefault(value, np.zeros(len(self.doc_ids)))
                given[place] = max(given[place], weight)
        self._seen: tuple = (None,)

    def _known(self, block: QueryBlock) -> tuple[np.ndarray, np.ndarray]:
        """Where the range's terms stand among the block's, and which of them do."""
        if self._seen[0] is not block:
            if len(block.terms):
                at = np.minimum(np.searchsorted(block.terms, self.terms), len(block.terms) - 1)
                self._seen = block, at, block.terms[at] == self.terms
            else:
                self._seen = block, np.zeros(len(self.terms), np.int64), np.zeros(len(self.terms), bool)
        return self._seen[1:]

    def dense(self, block: QueryBlock, part: int) -> np.ndarray:
        """The block's terms x documents of a part."""
        at, known = self._known(block)
        term, place, weight = self.parts[part]
        there = known[term]
        dense = np.zeros((len(block.terms), self.cuts[part + 1] - self.cuts[part]))
        dense[at[term[there]], place[there]] = weight[there]
        return dense

    def top(self, block: QueryBlock) -> np.ndarray:
        """Parts x the block's terms: the largest weight of each."""
        at, known = self._known(block)
        top = np.zeros((len(self.tops), len(block.terms)))
        top[:, at[known]] = self.tops[:, known]
        return top

    def boost(self, block: QueryBlock, rows: np.ndarray, part: int) -> np.ndarray | None:
        """rows x documents of a part: the sum over the kinds (a value's first letter) of the largest weight an asked value
        gives; none if no value asked for in the block favours a document of the range."""
        asked = self.marks.keys() & block.asking.keys()
        if not asked:
            return None
        lists, at = np.unique(block.list_of[rows], return_inverse=True)
        place = np.full(len(block.lists), -1)
        place[lists] = np.arange(len(lists))
        here = slice(self.cuts[part], self.cuts[part + 1])
        of_kind: dict[str, np.ndarray] = {}
        for value in asked:
            given = self.marks[value][here]
            boosts = of_kind.setdefault(value[0], np.zeros((len(lists), len(given))))
            asking = place[block.asking[value]]
            asking = asking[asking >= 0]
            boosts[asking] = np.maximum(boosts[asking], given)
        return sum(boosts for _, boosts in sorted(of_kind.items()))[at]

    def most_boosts(self, block: QueryBlock) -> np.ndarray | None:
        """Parts x the block's lists of asked values: a boost that no document of the part exceeds; none if all are 0."""
        of_kind: dict[str, np.ndarray] = {}
        for value in self.marks.keys() & block.asking.keys():
            boosts = of_kind.setdefault(value[0], np.zeros((len(self.tops), len(block.lists))))
            asking = block.asking[value]
            most = np.maximum.reduceat(self.marks[value], self.cuts[:-1])
            boosts[:, asking] = np.maximum(boosts[:, asking], most[:, None])
        return sum(of_kind.values()) if of_kind else None
