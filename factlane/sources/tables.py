"""The knowledge base and the term index as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlane.operators.termindex import TermIndex
from factlane.schemas import KB_COLUMNS, KB_SCHEMA, validate_kb


def write_kb(kb: DataFrame, path: str, by_city: bool = False) -> None:
    """Parquet, the form to answer from; ``by_city`` lets a city filter skip files."""
    writer = kb.select(*KB_COLUMNS).write.mode("overwrite")
    (writer.partitionBy("city") if by_city else writer).parquet(path)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return validate_kb(spark.read.parquet(path)).select(*KB_COLUMNS)


def write_kb_csv(kb: DataFrame, path: str) -> None:
    """CSV export; quotes are doubled, line breaks stay inside quotes."""
    kb.select(*KB_COLUMNS).write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_kb_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported knowledge base; empty cells come back as null."""
    return (
        spark.read.schema(KB_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def write_index(index: TermIndex, path: str, partitions: int | None = None) -> None:
    """The vocabulary, document vectors, their ranges, and postings sorted by term.

    Common terms are in almost every document; postings are therefore placed by
    range of (term, document), which cuts a common term into several files.
    """
    index.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    index.documents.write.mode("overwrite").parquet(f"{path}/documents")
    index.in_ranges().write.mode("overwrite").parquet(f"{path}/ranges")
    stored = read_index(index.vocabulary.sparkSession, path)
    order = ["term", "doc_id"]
    postings = stored.postings()
    spread = postings.repartitionByRange(partitions, *order) if partitions else postings.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(*[spark.read.parquet(f"{path}/{table}") for table in ("vocabulary", "documents", "ranges")])


def read_postings(spark: SparkSession, path: str, term: str | None = None) -> DataFrame:
    """Postings, of one term if given; the filter reaches the files' statistics."""
    postings = spark.read.parquet(f"{path}/postings")
    return postings if term is None else postings.where(F.col("term") == term)
