"""CSV files cut into records, by many tasks a file, line breaks inside quotes included.

Spark's text source deals out byte ranges of the files as lines.  Whether a line begins
inside a quoted cell depends on everything before it, so a range is traced under both
answers.  A range then is a function from the state at its begin to the state at its end;
composed over the ranges of a file, in order, these say which answer holds in each.
Lines that are records by themselves stay where they lie, only the others are shuffled
to be put together.  Files are read once.

Delimiters, quotes and line ends are never part of a UTF-8 or GBK character, so bytes
are traced without decoding them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlane.scale import BROADCAST_ROWS, durable

#: What is inside a quoted cell: all up to a lone quote.
_INSIDE = re.compile(rb'[^"]*+(?:""[^"]*+)*+')

_TRACED = """file string, block long, line long, value binary, utf8 boolean, gbk boolean,
plain_begin boolean, plain_end boolean, plain_first long, quoted_begin boolean, quoted_end boolean, quoted_first long"""


def ends_quoted(line: bytes, quoted: bool) -> bool:
    """Whether a quoted cell is open after ``line``; ``quoted`` tells whether one was before it.

    A quote opens a cell only as its first byte; what follows a closing quote belongs to
    the cell up to the next comma.
    """
    if b'"' not in line:
        return quoted
    at = 0
    if not quoted and line.startswith(b'"'):
        quoted, at = True, 1
    while True:
        if quoted:
            at = _INSIDE.match(line, at).end()
            if at == len(line):
                return True
        at = line.find(b",", at) + 1
        if not at:
            return False
        quoted = line.startswith(b'"', at)
        at += quoted


def _valid(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, states = None, [False, True]
    firsts: list[int | None] = [None, None]
    for batch in batches:
        made: dict[str, list] = {name: [] for name in ("utf8", "gbk")}
        traces: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
        files, blocks, numbers, values = (batch.column(i).to_pylist() for i in range(4))
        for file, block, number, value in zip(files, blocks, numbers, values):
            if (file, block) != place:
                place, states, firsts = (file, block), [False, True], [None, None]
            ascii_only = value.isascii()
            made["utf8"].append(ascii_only or _valid(value, "utf-8"))
            made["gbk"].append(ascii_only or _valid(value, "gbk"))
            for i, (begins, ends, first) in enumerate(traces):
                begins.append(states[i])
                if not states[i]:
                    firsts[i] = number
                states[i] = ends_quoted(value, states[i])
                ends.append(states[i])
                first.append(firsts[i])
        columns = [*batch.columns, pa.array(made["utf8"], pa.bool_()), pa.array(made["gbk"], pa.bool_())]
        for begins, ends, first in traces:
            columns += [pa.array(begins, pa.bool_()), pa.array(ends, pa.bool_()), pa.array(first, pa.int64())]
        names = [field.split()[0] for field in _TRACED.split(",")]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def traced_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of the files, written once, with their states under both answers.

    ``plain_*`` holds if the range begins outside quotes, ``quoted_*`` if inside:
    whether the line begins and ends inside, and the first line of its record (null
    if that lies before the range).
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").cast("long").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").cast("binary").alias("value"),
    )
    return durable(lines.mapInArrow(_trace, _TRACED))


def block_states(lines: DataFrame) -> DataFrame:
    """A row per range: whether it begins and ends inside quotes, and the record open at its begin.

    Also whether its lines are valid UTF-8 and GBK, and its first line's number.  The rows
    of one file, a few numbers for each of its ranges, go through one task.
    """
    blocks = lines.groupBy("file", "block").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_and("gbk").alias("gbk"),
        F.min("line").alias("head"),
        F.max_by(F.struct("plain_end", "plain_first", "quoted_end", "quoted_first"), "line").alias("last"),
    )
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain, quoted = F.col("last.plain_end"), F.col("last.quoted_end")
    # a range keeps the state, turns it round, or ends in one state whatever came before
    turns = F.sum((plain & ~quoted).cast("int")).over(so_far)
    staged = blocks.withColumn("turns", turns).withColumn(
        "fixed", F.last(F.when(plain == quoted, plain.cast("int") + F.col("turns")), ignorenulls=True).over(so_far)
    )
    staged = staged.withColumn("ends", (F.coalesce("fixed", F.lit(0)) + F.col("turns")) % 2 == 1)
    staged = staged.withColumn("begins", F.lag("ends", 1, False).over(order))
    opened = F.when(F.col("begins"), F.when(quoted, F.col("last.quoted_first"))).otherwise(F.when(plain, F.col("last.plain_first")))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return staged.withColumn("opened", opened).select(
        "file", "block", "head", "utf8", "gbk", "begins", "ends",
        F.last("opened", ignorenulls=True).over(before).alias("open"),
    )


def placed_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, block, line, value, record, whole): ``record`` is the first line of the line's record.

    ``blocks`` has a row per range of the size Spark reads at once; it is sent around
    unless its rows, counted, are too many.
    """
    states = blocks.select("file", "block", "begins", "open")
    if states.count() <= BROADCAST_ROWS:
        states = F.broadcast(states)
    pick = lambda name: F.when(F.col("begins"), F.col(f"quoted_{name}")).otherwise(F.col(f"plain_{name}"))
    return lines.join(states, ["file", "block"]).select(
        "file", "block", "line", "value",
        F.coalesce(pick("first"), F.col("open")).alias("record"),
        (~pick("begin") & ~pick("end")).alias("whole"),
    )


def long_records(placed: DataFrame, max_bytes: int) -> DataFrame:
    """The files with a record of several lines and more than ``max_bytes``."""
    sizes = placed.where("not whole").groupBy("file", "record").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    return sizes.where(F.col("bytes") > max_bytes).select("file").distinct()


def records(placed: DataFrame) -> DataFrame:
    """(file, block, record, value): whole records as bytes, without the last line end, blank lines left out."""
    # texts of any bytes: they are joined as they are
    parts = placed.where("not whole").select("file", "record", F.struct("block", "line", F.col("value").cast("string").alias("value")).alias("part"))
    joined = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
        "file", F.get("parts", F.lit(0))["block"].alias("block"), "record",
        F.array_join(F.transform("parts", lambda p: p["value"]), "\n").cast("binary").alias("value"),
    )
    single = placed.where("whole").select("file", "block", "record", "value")
    ended = F.expr("if(endswith(value, X'0D'), substring(value, 1, octet_length(value) - 1), value)")
    return single.unionByName(joined).withColumn("value", ended).where(F.octet_length("value") > 0)
