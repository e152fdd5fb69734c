"""Words and lines of whole texts, as Spark expressions and as bytes in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: what separates words.  Python's ``bytes.split()`` splits at the same six bytes.
SPACES = " \t\n\x0b\f\r"


def whole(text: Column | str) -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """The runs of characters other than SPACES, in order."""
    return F.array_remove(F.split(F.translate(whole(text), SPACES, " " * len(SPACES)), " "), "")


def n_words(text: Column | str) -> Column:
    return F.size(words(text)).cast("long")


def remainder(doc_id: Column | str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a missing id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_bytes(texts: list[bytes], most: int) -> Iterator[range]:
    """The positions of ``texts`` in runs of about ``most`` bytes, a text never cut."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most or i == len(texts) - 1:
            yield range(first, i + 1)
            first, size = i + 1, 0


def per_text(
    df: DataFrame, text: str, added: str, function: Callable[[list[bytes]], list[list]], keep_text: bool = False
) -> DataFrame:
    """``df`` with new columns after its own; ``text`` itself goes unless it is kept.

    ``function`` gets a batch of texts as UTF-8 bytes (missing: empty) and gives
    one list of values for each column of the schema ``added``.
    """
    keep = [c for c in df.columns if keep_text or c != text]
    fields = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    new = df.sparkSession.createDataFrame([], added).schema
    for field in new:
        fields = fields.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(new)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(at := batch.schema.get_field_index(text))
            values = function([b or b"" for b in column.cast(pa.binary()).to_pylist()])
            own = [i for i in range(batch.num_columns) if keep_text or i != at]
            old = [batch.column(i) for i in own]
            made = [pa.array(v, type=f.type) for v, f in zip(values, kinds)]
            names = [batch.schema.names[i] for i in own] + kinds.names
            yield pa.RecordBatch.from_arrays(old + made, names=names)

    return df.mapInArrow(run, fields)
