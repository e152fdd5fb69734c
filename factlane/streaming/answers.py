"""Questions that keep arriving, answered by the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factlane.functions.intents import with_keyword_intent
from factlane.operators.lexicon import entity_index
from factlane.operators.substrings import SubstringIndex
from factlane.plans.rule_qa import answer_sources, rule_qa
from factlane.scale import durable


def stream_rule_qa(
    questions: DataFrame,
    kb: DataFrame,
    target: str,
    checkpoint: str,
    index: SubstringIndex | None = None,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Writes the rule answers of a stream of (qid, text) to ``target``.

    Each micro-batch runs the batch plan and overwrites its own folder
    ``batch=<id>``, so a batch replayed after a failure replaces itself.  The
    dictionary, the slots and the city lists are made once, before the stream starts.
    """
    kb = durable(kb)
    index = index or entity_index(kb)
    sources = tuple(durable(x) for x in answer_sources(kb))

    def answer_batch(batch: DataFrame, batch_id: int) -> None:
        rule_qa(batch, kb, index=index, sources=sources).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = questions.writeStream.foreachBatch(answer_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def stream_intents(questions: DataFrame) -> DataFrame:
    """Keyword intents on a stream: a plain projection, no state."""
    return with_keyword_intent(questions)


def read_answers(spark, target: str) -> DataFrame:
    """All answers written so far."""
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*").withColumn(
        "batch", F.col("batch").cast("long")
    )
