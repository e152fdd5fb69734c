"""Retrieval answers: documents, hybrid top-k, prompts, generation, fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlane import constants as C
from factlane.config import RetrievalConfig
from factlane.functions.clean import strip
from factlane.functions.intents import with_keyword_intent
from factlane.functions.render import fill, value_or_missing
from factlane.operators.boosts import asked_values, marked, most_boosted, recognised_values, value_documents
from factlane.operators.lexicon import entity_index, recognise
from factlane.operators.ranges import build_ranges
from factlane.operators.retrieval import Scoring, ranked, search
from factlane.operators.substrings import SubstringIndex
from factlane.operators.termindex import TermIndex, build_index, query_vectors
from factlane.plans.rule_qa import entity_struct
from factlane.scale import durable, salted_lookup, spread_small
from factlane.sources import index_store

#: From prompts (qid, system_prompt, prompt) and the settings to (qid, generated, status).
Generator = Callable[[DataFrame, RetrievalConfig], DataFrame]


def row_documents(kb: DataFrame) -> DataFrame:
    """(doc_id, name, city, content): one labelled line per field."""
    lines = [
        F.concat(F.lit(f"【{label}】"), value_or_missing(kb, field)) for field, label in C.DOCUMENT_LABELS.items()
    ]
    name = F.col("name") if "name" in kb.columns else F.concat(F.lit("景点"), F.col("dataid"))
    city = F.col("city") if "city" in kb.columns else F.lit("未知城市")
    return kb.select(
        F.col("dataid").alias("doc_id"),
        name.alias("name"),
        city.alias("city"),
        strip(F.concat_ws("\n", *lines)).alias("content"),
    )


def document_index(kb: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> TermIndex:
    """The index of a knowledge base; its documents are written with their vectors, and in ranges by city."""
    index = build_index(row_documents(kb), "content", config.max_features)
    documents = durable(index.documents)
    return TermIndex(index.vocabulary, documents, build_ranges(documents, beside=("city",)))


def stored_document_index(kb: DataFrame, path: str, config: RetrievalConfig = RetrievalConfig()) -> TermIndex:
    """The index stored at ``path``, made of ``kb`` if there is none; later rows are added by ``add_to_index``."""
    if not index_store.exists(kb.sparkSession, path):
        add_to_index(kb, path)
    return index_store.open_index(kb.sparkSession, path, config, beside=("city",))


def add_to_index(kb: DataFrame, path: str) -> int:
    """Adds the documents of new rows to the index stored at ``path``; returns its version."""
    return index_store.append(spread_small(row_documents(kb)), path, "content")


def retrieve(
    questions: DataFrame,
    index: TermIndex,
    entities: SubstringIndex | None,
    config: RetrievalConfig = RetrievalConfig(),
    broadcast: bool | None = None,
) -> DataFrame:
    """(qid, rank, doc_id, score, tfidf_score, entity_boost).

    With an entity index a question is also matched by its recognised cities,
    provinces and names; without one by cosine alone.

    The score of a question that favours documents is a share of the cosine and a larger share of the
    boost.  One search goes by both: ranges of documents are bounded by their largest weights and
    boosts, so those of low boost are left out once k documents of a higher one are found.
    """
    scoring = Scoring(config.top_k, config.min_score, C.FUSE_COSINE, C.FUSE_BOOST)
    queries, ranges = query_vectors(questions, "text", index.vocabulary), index.in_ranges()
    if entities is not None:
        known = durable(recognise(questions.select("qid", "text"), entities).select("qid", "names", "cities", "provinces"))
        documents = index.documents.select("doc_id", "name", "city", "content")
        favoured = durable(value_documents(durable(recognised_values(known)), documents, broadcast))
        asked = F.coalesce("asked", F.array().cast("array<string>")).alias("asked")
        queries = queries.join(asked_values(known, favoured), "qid", "left").select("qid", "terms", "weights", asked)
        ranges = marked(ranges, favoured)
    found = search(queries, ranges, scoring, broadcast)
    return ranked(found, scoring).select(
        "qid", "rank", "doc_id", "score", F.col("cosine").alias("tfidf_score"), F.col("boost").alias("entity_boost")
    )


def with_documents(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with name, city and content.

    The hits, a few numbers per question, are written out: scoring is the costly
    step and prompts and answers both follow from it.  Many hits may be on one
    document, so the lookup is salted, but only documents with a hit take part.
    """
    written = durable(hits)
    wanted = documents.select("doc_id", "name", "city", "content").join(
        written.select("doc_id").distinct(), "doc_id", "left_semi"
    )
    return salted_lookup(written, wanted, "doc_id", F.col("qid"))


def entity_boosts(questions: DataFrame, kb: DataFrame) -> DataFrame:
    """(kind, value, doc_id, weight): every document that a value recognised in some question favours."""
    known = recognise(questions.select("qid", "text"), entity_index(kb))
    values = durable(recognised_values(known))
    return value_documents(values, durable(row_documents(kb))).select("kind", "value", "doc_id", "weight")


def question_boosts(questions: DataFrame, kb: DataFrame) -> DataFrame:
    """(qid, max_boost): the most that any document is favoured for a question."""
    known = durable(recognise(questions.select("qid", "text"), entity_index(kb)).select("qid", "names", "cities", "provinces"))
    return most_boosted(known, durable(row_documents(kb)))


def hybrid_hits(
    questions: DataFrame, kb: DataFrame, config: RetrievalConfig = RetrievalConfig(), broadcast: bool | None = None
) -> DataFrame:
    """Top-k hits with their documents' fields."""
    index = document_index(kb, config)
    hits = retrieve(questions, index, entity_index(kb), config, broadcast)
    return with_documents(hits, index.documents)


def score_breakdown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "rank", "name", "city", "score", "tfidf_score", "entity_boost")


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, system_prompt, prompt) for the questions that have hits."""
    block = fill(
        C.PROMPT_DOCUMENT, {"rank": F.col("rank"), "name": F.col("name"), "content": F.col("content")}
    )
    listed = hits.select("qid", "rank", block.alias("block")).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("blocks")
    )
    documents = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return questions.join(listed, "qid").select(
        "qid",
        F.lit(C.SYSTEM_PROMPT).alias("system_prompt"),
        fill(C.USER_PROMPT, {"documents": documents, "question": F.col("text")}).alias("prompt"),
    )


def _line_value(line: Column) -> Column:
    return strip(F.element_at(F.split(line, "】"), -1))


def template_answer(question: Column, name: Column, content: Column) -> Column:
    """An answer taken from a document's labelled lines."""
    label = F.coalesce(*[F.when(question.contains(k), F.lit(v)) for k, v in C.ANSWER_LABEL_RULES.items()])
    lines = F.split(content, "\n")
    line = F.get(F.filter(lines, lambda x: x.contains(label)), F.lit(0))
    value = _line_value(line)
    usable = (value != "") & (value != C.MISSING)
    summaries = F.filter(
        F.transform(F.filter(lines, lambda x: x.contains(C.SUMMARY_LABEL)), _line_value),
        lambda v: (v != "") & (v != C.MISSING),
    )
    summary = F.get(summaries, F.lit(0))
    cut = F.when(
        F.length(summary) > C.SUMMARY_LENGTH, F.concat(F.substring(summary, 1, C.SUMMARY_LENGTH), F.lit("..."))
    ).otherwise(summary)
    return (
        F.when(line.isNotNull() & usable, fill(C.FIELD_ANSWER, {"name": name, "label": label, "value": value}))
        .when(line.isNotNull(), fill(C.FIELD_ANSWER_MISSING, {"name": name, "label": label}))
        .when(summary.isNotNull(), fill(C.SUMMARY_ANSWER, {"name": name, "value": cut}))
        .otherwise(fill(C.GENERIC_ANSWER, {"name": name}))
    )


def template_answers(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, template) from the best hit of each question."""
    first = hits.where(F.col("rank") == 1).select("qid", "name", "content")
    return questions.join(first, "qid").select(
        "qid", template_answer(F.col("text"), F.col("name"), F.col("content")).alias("template")
    )


# --- generation -------------------------------------------------------------

GENERATED = "qid long, generated string, status string"


def from_batches(complete: Callable[[pd.DataFrame, RetrievalConfig], pd.Series]) -> Generator:
    """A generator from a function of one Arrow batch of (qid, system_prompt, prompt) and the settings.

    It returns one text per row.  If a batch raises, its rows are tried one by one, so
    that only the rows that fail by themselves are marked as failed.
    """

    def run(prompts_df: DataFrame, config: RetrievalConfig) -> DataFrame:
        def attempt(batch: pd.DataFrame) -> pd.DataFrame:
            try:
                texts = list(complete(batch, config))
                return pd.DataFrame({"qid": batch["qid"], "generated": texts, "status": "ok"})
            except Exception as error:  # noqa: BLE001 - reported in the status column
                if len(batch) > 1:
                    return pd.concat([attempt(batch.iloc[i:i + 1]) for i in range(len(batch))])
                return pd.DataFrame({"qid": batch["qid"], "generated": None, "status": f"error: {error}"})

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield attempt(batch)

        return prompts_df.select("qid", "system_prompt", "prompt").mapInPandas(each, GENERATED)

    return run


def offline(prompts_df: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The built-in generator: no model is reachable, every prompt falls back."""
    return prompts_df.select(
        "qid", F.lit(None).cast("string").alias("generated"), F.lit("error: no model configured").alias("status")
    )


DEFAULT_PROVIDER = "offline"


def choose_generator(provider: str, registered: dict[str, Generator] | None = None) -> Generator:
    """The generator registered under a name, case aside; unknown names get the default."""
    known = {DEFAULT_PROVIDER: offline, **{k.lower(): v for k, v in (registered or {}).items()}}
    return known.get(provider.lower(), known[DEFAULT_PROVIDER])


def generate(
    prompts_df: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    registered: dict[str, Generator] | None = None,
) -> DataFrame:
    return choose_generator(config.provider, registered)(prompts_df, config)


def with_fallback(generated: DataFrame, templates: DataFrame) -> DataFrame:
    """(qid, answer, use_llm): the generated text unless generation failed.

    Failed means a status other than ok, no text, or a text with a failure marker.
    """
    text = F.col("generated")
    marked = F.lit(False)
    for marker in C.FAILURE_MARKERS:
        marked = marked | text.contains(marker)
    failed = (F.col("status") != "ok") | text.isNull() | marked
    return templates.join(generated, "qid", "left").select(
        "qid",
        F.when(F.coalesce(failed, F.lit(True)), F.col("template")).otherwise(text).alias("answer"),
        (~F.coalesce(failed, F.lit(True))).alias("use_llm"),
    )


def retrieval_qa(
    questions: DataFrame,
    kb: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    use_llm: bool = False,
    registered: dict[str, Generator] | None = None,
    index: TermIndex | None = None,
    entities: SubstringIndex | None = None,
) -> DataFrame:
    """(qid, question, retrieved_docs, prompt, answer, use_llm, intent,
    intent_confidence, entities, matched), one row per question."""
    index = index or document_index(kb, config)
    entities = entities or entity_index(kb)
    hits = with_documents(retrieve(questions, index, entities, config), index.documents)
    # k hits per question at most
    listed = hits.groupBy("qid").agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank", "doc_id", "name", "city", "content", "score", "tfidf_score", "entity_boost")
            )
        ).alias("retrieved_docs")
    )
    understood = recognise(with_keyword_intent(questions), entities)
    joined = understood.join(listed, "qid", "left")
    first = F.get("retrieved_docs", F.lit(0))
    has_hit = F.col("retrieved_docs").isNotNull()
    blocks = F.array_join(
        F.transform(
            "retrieved_docs",
            lambda d: fill(C.PROMPT_DOCUMENT, {"rank": d["rank"], "name": d["name"], "content": d["content"]}),
        ),
        "\n\n",
    )
    full = joined.select(
        "qid",
        F.col("text").alias("question"),
        F.coalesce("retrieved_docs", F.array().cast(joined.schema["retrieved_docs"].dataType)).alias("retrieved_docs"),
        F.when(has_hit, fill(C.USER_PROMPT, {"documents": blocks, "question": F.col("text")}))
        .otherwise(F.lit("")).alias("prompt"),
        F.when(has_hit, template_answer(F.col("text"), first["name"], first["content"]))
        .otherwise(F.lit(C.NO_HIT_ANSWER)).alias("answer"),
        F.lit(False).alias("use_llm"),
        "intent",
        "intent_confidence",
        entity_struct().alias("entities"),
        F.coalesce(F.when(has_hit, first["name"]), F.get("names", F.lit(0))).alias("matched"),
    )
    if not use_llm:
        return full
    asked = full.where(F.size("retrieved_docs") > 0).select(
        "qid", F.lit(C.SYSTEM_PROMPT).alias("system_prompt"), "prompt"
    )
    templates = full.select("qid", F.col("answer").alias("template"))
    final = with_fallback(generate(asked, config, registered), templates)
    return full.drop("answer", "use_llm").join(final, "qid").select(*full.columns)
