"""Raw city exports: many CSV files in UTF-8 or GBK, with differing columns.

Files are read once, as records (``csv_records``); large ones by many tasks, also where
line breaks stand inside quotes.  A record is decoded as its file asks, cut into cells by
Spark's own CSV parser, and its cells are picked by the place its file's header gives them.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlane.constants import CSV_NULLS, RAW_COLUMNS
from factlane.scale import durable
from factlane.sources.csv_records import block_states, long_records, placed_lines, records, traced_lines

GBK = "gbk"
UTF8 = "utf-8"
MAX_RECORD_BYTES = 64 * 1024 * 1024


@F.pandas_udf(T.StringType())
def _decode_gbk(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else text.decode(GBK))


@dataclass(frozen=True)
class SourceFile:
    """One readable file.  ``uri`` is how Spark reports it, ``first`` the number of its first record."""

    uri: str
    entry: str
    encoding: str
    header: list[str]
    first: int


def _existing(spark: SparkSession, folder: str, entries: list[str]) -> list[str]:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [(entry, jvm.org.apache.hadoop.fs.Path(f"{folder}/{entry}")) for entry in entries]
    return [entry for entry, path in paths if path.getFileSystem(conf).exists(path)]


def _header(text: bytes, encoding: str) -> list[str]:
    decoded = text.decode(encoding).removeprefix("﻿")
    return next(csv.reader(io.StringIO(decoded, newline=""), strict=False))


def readable_files(blocks: DataFrame, placed: DataFrame, found: DataFrame, entries: list[str]) -> list[SourceFile]:
    """The files that can be decoded, and whose records all end and are not too long.

    A row per file reaches the driver, as do the headers.
    """
    files = blocks.groupBy("file").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_and("gbk").alias("gbk"),
        F.max_by("ends", "block").alias("open"),
        F.min_by("head", "block").alias("record"),
    )
    files = files.join(long_records(placed, MAX_RECORD_BYTES), "file", "left_anti")
    files = durable(files.where("(utf8 or gbk) and not open").coalesce(1))
    heads = found.join(F.broadcast(files), ["file", "record"]).select("file", "record", "utf8", "value").collect()

    def entry_of(path: str) -> str:
        tails = [e for e in entries if path.endswith(f"/{e}") or f"/{e}/" in path]
        return max(tails, key=len)

    made = []
    for row in sorted(heads, key=lambda r: r["file"]):
        encoding = UTF8 if row["utf8"] else GBK
        header = _header(bytes(row["value"]), encoding)
        made.append(SourceFile(row["file"], entry_of(unquote(row["file"])), encoding, header, row["record"]))
    return made


def _cells(text: Column, width: int) -> Column:
    """The cells of a record, ``width`` of them, null where there are fewer."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    read = F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"'})
    return F.array(*[read[f"c{i}"] for i in range(width)])


def read_city_files(
    spark: SparkSession, folder: str, cities: dict[str, str], columns: list[str] = RAW_COLUMNS
) -> DataFrame:
    """All rows of the entries in ``cities`` (file or folder below ``folder`` -> city).

    Result: ``columns`` as text (null where a file lacks one), ``city`` and ``ord``,
    which orders rows by file, in the order of ``cities``, and place in the file.
    A file that is missing, empty, in neither encoding, has a row with more cells than
    its header, a quoted cell that never ends or one record of several lines and more
    than MAX_RECORD_BYTES is left out as a whole, and the others are read.  Lines end
    with a line feed, a carriage return before it belongs to the line end.  Of columns
    of one name the first is read.
    """
    entries = _existing(spark, folder, list(cities))
    files: list[SourceFile] = []
    if entries:
        lines = traced_lines(spark, [f"{folder}/{entry}" for entry in entries])
        blocks = durable(block_states(lines))
        placed = placed_lines(lines, blocks)
        found = records(placed)
        files = readable_files(blocks, placed, found, entries)
    if not files:
        fields = ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([], f"{fields}, city string, ord struct<file: bigint, block: bigint, line: bigint>")
    order = {entry: i for i, entry in enumerate(cities)}
    ranked = sorted(files, key=lambda f: (order[f.entry], unquote(f.uri)))
    place = [[f.header.index(c) + 1 if c in f.header else 0 for c in columns] for f in ranked]
    known = spark.createDataFrame(
        [(f.uri, cities[f.entry], i, f.first, f.encoding == GBK, len(f.header), place[i]) for i, f in enumerate(ranked)],
        "file string, city string, rank bigint, first bigint, gbk boolean, width int, places array<int>",
    )
    text = F.col("value").cast("string")
    # blank lines go before decoding: a filter on decoded text would move below the join, to other files' rows
    rows = found.where(F.trim(text) != "").join(F.broadcast(known), "file").where("record <> first")
    decoded = rows.where("not gbk").withColumn("text", text).unionByName(rows.where("gbk").withColumn("text", _decode_gbk("value")))
    # one cell more than the widest header: a row that fills the one past its own header has too many
    cells = decoded.select("*", _cells(F.col("text"), max(len(f.header) for f in files) + 1).alias("cells"))

    def cell(i: int) -> Column:
        value = F.try_element_at("cells", F.nullif(F.get("places", F.lit(i)), F.lit(0)))
        return F.when(~value.isin(CSV_NULLS), value)

    parsed = durable(
        cells.select(
            *[cell(i).alias(f"_{i}") for i in range(len(columns))],
            "city",
            F.struct(F.col("rank").alias("file"), "block", F.col("record").alias("line")).alias("ord"),
            F.element_at("cells", F.col("width") + 1).isNotNull().alias("malformed"),
        )
    )
    # a row per file at most
    broken = F.broadcast(parsed.where("malformed").select(F.col("ord.file").alias("broken")).distinct())
    return parsed.join(broken, F.col("ord.file") == F.col("broken"), "left_anti").select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)], "city", "ord"
    )
