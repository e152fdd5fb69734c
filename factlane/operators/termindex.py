"""TF-IDF as tables: term counts, vocabulary, weights, row vectors.

A text is one row: its terms are counted in Arrow batches, its weights and length are
computed inside the row by array functions.  The corpus is never shuffled: only the term
statistics are, after each task has summed its own, and the vocabulary that
comes out of them is limited and reaches the rows as a constant.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlane.functions.terms import gap_words, word_tokens
from factlane.operators.ranges import build_ranges
from factlane.scale import durable, spread_small

BUCKETS = 8192
COUNTS = "_counts"
#: So many words and counts a task has as Python objects.
COUNTS_AT_ONCE = 1 << 16
#: So many bytes of text a task cuts into characters at once, whatever Arrow's batches hold.
TEXT_AT_ONCE = 1 << 20
COUNT_TYPE = "array<struct<term: string, tf: bigint>>"
#: The number of a single space.
SPACE = ord(" ") << 22


def _counts_column(ends: list[int], terms: pa.Array, counts: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([terms, counts], ["term", "tf"]))


def _char_counts(words: pa.Array) -> pa.Array:
    """Counts of single characters and pairs of texts whose words have one space between them.

    A term is one number, its characters' codes, so that a text's terms are sorted and counted as numbers.
    """
    keys, counts, ends = [], [], [0]
    for text in words.to_pylist():
        if text:
            codes = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
            key, n = np.unique(np.concatenate([codes << 22, (codes[:-1] << 22) | (codes[1:] + 1)]), return_counts=True)
            # the words one by one, each between spaces, have two spaces where the text has one
            n[key == SPACE] = 2 * (n[key == SPACE] - 1)
            keys.append(key)
            counts.append(n)
        ends.append(ends[-1] + (len(key) if text else 0))
    distinct, at = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_inverse=True)
    names = [chr(k >> 22) + (chr((k & 0x3FFFFF) - 1) if k & 0x3FFFFF else "") for k in distinct.tolist()]
    return _counts_column(ends, pa.array(names, pa.string()).take(pa.array(at)), pa.array(np.concatenate(counts or [np.empty(0, np.int64)])))


def _pieces(words: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring rows of about TEXT_AT_ONCE bytes, one at least."""
    piece = np.cumsum(pc.fill_null(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(words)]
    return (words.slice(start, end - start) for start, end in zip(cuts, cuts[1:]))


def _char_counts_in_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for words in batches:
        yield from map(_char_counts, _pieces(words))


def _word_counts(words: bool, pairs: bool):
    def counted(tokens: pa.Array) -> pa.Array:
        # rows become Python objects one by one, and their counts Arrow's again before they are many
        terms, counts, ends, made = [], [], [0], []
        for row in tokens:
            row = row.as_py()
            n = Counter(row or () if words else ())
            if pairs and row:
                n.update(map(" ".join, zip(row, row[1:])))
            listed = sorted(n)
            terms += listed
            counts += map(n.get, listed)
            ends.append(ends[-1] + len(listed))
            if len(terms) >= COUNTS_AT_ONCE:
                made.append((pa.array(terms, pa.string()), pa.array(counts, pa.int64())))
                terms, counts = [], []
        made.append((pa.array(terms, pa.string()), pa.array(counts, pa.int64())))
        return _counts_column(ends, *map(pa.concat_arrays, zip(*made)))

    return counted


def with_char_counts(texts: DataFrame, text: str) -> DataFrame:
    """Adds the array of (term, tf) of each row, in term order: single characters and character pairs of each space-padded word.

    Pairs are taken from all words in one go, written with one space between
    them: no pair reaches over a space.
    """
    return texts.withColumn(COUNTS, F.arrow_udf(_char_counts_in_pieces, COUNT_TYPE)(gap_words(F.col(text))))


def with_word_counts(texts: DataFrame, text: str, words: bool = True, pairs: bool = True) -> DataFrame:
    """Adds the counts of words and pairs of neighbouring words."""
    return texts.withColumn(COUNTS, F.arrow_udf(_word_counts(words, pairs), COUNT_TYPE)(word_tokens(F.col(text))))


def count_rows(counted: DataFrame, key: str) -> DataFrame:
    """The counts as rows.

    The outer form, since for the inner one the optimiser adds a test for empty
    arrays, moves it below all projections and so computes the counts twice.
    """
    return counted.select(key, F.inline_outer(COUNTS)).where(F.col("term").isNotNull())


def char_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of characters and character pairs."""
    return count_rows(with_char_counts(spread_small(texts.select(key, text)), text), key)


def word_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of words."""
    return count_rows(with_word_counts(spread_small(texts.select(key, text)), text, pairs=False), key)


def word_bigrams(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of pairs of neighbouring words."""
    return count_rows(with_word_counts(spread_small(texts.select(key, text)), text, words=False), key)


def word_and_pair_terms(texts: DataFrame, key: str, text: str) -> DataFrame:
    return count_rows(with_word_counts(spread_small(texts.select(key, text)), text), key)


def term_totals(counts: DataFrame) -> DataFrame:
    """(term, df, cf): texts that hold the term, and how often they do."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def with_idf(totals: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds idf = ln((1 + n) / (1 + df)) + 1."""
    n = texts.agg(F.count("*").alias("n")).scalar()
    return totals.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def term_idf(counts: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, df, cf, idf) of the texts whose counts are given."""
    return with_idf(term_totals(counts), texts)


def prune_vocabulary(
    terms: DataFrame, texts: DataFrame, max_features: int, min_df: int = 1, max_df: float = 1.0
) -> DataFrame:
    """The ``max_features`` most frequent terms within the document-frequency limits."""
    kept = terms
    if min_df > 1:
        kept = kept.where(F.col("df") >= min_df)
    if max_df < 1.0:
        n = texts.agg(F.count("*").alias("n")).scalar()
        kept = kept.where(F.col("df") <= max_df * n)
    return kept.orderBy(F.desc("cf"), "term").limit(max_features)


def numbered(vocabulary: DataFrame) -> DataFrame:
    """Adds ``idx``.  The vocabulary is limited, so one ordered pass over it is small."""
    return vocabulary.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _constant(vocabulary: DataFrame) -> Column:
    """The vocabulary as one constant: an array of buckets of (term, idx, idf).

    At most ``max_features`` terms, a bound that does not grow with the data, pass
    through the driver; the optimiser folds the expression to a literal.
    """
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for row in vocabulary.select("term", "idx", "idf", _bucket(F.col("term")).alias("bucket")).collect():
        buckets[row["bucket"]].append({"term": row["term"], "idx": row["idx"], "idf": row["idf"]})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<term: string, idx: int, idf: double>>>")


def with_vectors(counted: DataFrame, vocabulary: DataFrame, sublinear: bool = False) -> DataFrame:
    """Turns the counts of each row into ``terms`` (positions) and ``weights`` of length one.

    Terms that are not in the vocabulary are dropped; a row without any known term
    has empty arrays.
    """
    buckets = _constant(vocabulary)

    def found(entry: Column) -> Column:
        bucket = F.get(buckets, _bucket(entry["term"]))
        match = F.get(F.filter(bucket, lambda v: v["term"] == entry["term"]), F.lit(0))
        return F.struct(match.alias("match"), entry["tf"].cast("double").alias("tf"))

    def weigh(hit: Column) -> Column:
        tf = 1 + F.log(hit["tf"]) if sublinear else hit["tf"]
        return F.struct(hit["match"]["idx"].alias("idx"), (tf * hit["match"]["idf"]).alias("raw"))

    known = F.transform(F.filter(F.transform(COUNTS, found), lambda h: h["match"].isNotNull()), weigh)
    weighed = counted.withColumn("_known", known).drop(COUNTS)
    length = F.sqrt(F.aggregate("_known", F.lit(0.0), lambda acc, e: acc + e["raw"] * e["raw"]))
    # the length enters as an array: a column used inside a lambda may be inlined
    # there and would be worked out again for every element
    lengths = F.array_repeat(length, F.size("_known"))
    return weighed.select(
        *[c for c in counted.columns if c != COUNTS],
        F.transform("_known", lambda e: e["idx"]).alias("terms"),
        F.zip_with("_known", lengths, lambda e, n: e["raw"] / n).alias("weights"),
    )


def postings(vectors: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) rows of row vectors."""
    pairs = vectors.select(key, F.inline(F.arrays_zip("terms", "weights"))).withColumnRenamed("terms", "idx")
    words = F.broadcast(vocabulary.select("idx", "term"))
    return pairs.join(words, "idx").select(key, "term", F.col("weights").alias("weight"))


@dataclass(frozen=True)
class TermIndex:
    """A searchable table of documents.

    ``vocabulary``: term, df, cf, idf, idx.  ``documents``: the documents with
    ``terms`` and ``weights``; documents without a known term have empty arrays.
    ``ranges``: the documents' vectors as a block-max index, if it has been made; those of a
    stored index are there alone.
    """

    vocabulary: DataFrame
    documents: DataFrame
    ranges: DataFrame | None = None

    def in_ranges(self) -> DataFrame:
        return self.ranges if self.ranges is not None else build_ranges(self.documents)

    def postings(self, key: str = "doc_id") -> DataFrame:
        return postings(self.documents, self.vocabulary, key)


def build_index(documents: DataFrame, text: str, max_features: int, key: str = "doc_id") -> TermIndex:
    """Character TF-IDF of ``documents``; every other column is kept beside the vector.

    Cutting texts into terms is the costly step, so the counts are written once and
    read for the statistics and for the weights.
    """
    counted = durable(with_char_counts(spread_small(documents), text))
    terms = term_idf(count_rows(counted, key), counted)
    # written once: documents and, later, every set of queries are weighted by it
    vocabulary = durable(numbered(prune_vocabulary(terms, counted, max_features)))
    return TermIndex(vocabulary, with_vectors(counted, vocabulary))


def query_vectors(queries: DataFrame, text: str, vocabulary: DataFrame, key: str = "qid") -> DataFrame:
    """(key, terms, weights) under an existing vocabulary; unknown terms are dropped."""
    counted = with_char_counts(spread_small(queries.select(key, text)), text)
    return with_vectors(counted, vocabulary).select(key, "terms", "weights")
