"""One query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlane.catalog.views import Tables
from factlane.config import ClassifierConfig, RetrievalConfig
from factlane.constants import CITY_PROVINCE, RAW_COLUMNS
from factlane.functions import clean
from factlane.functions.intents import intent_description, with_keyword_intent
from factlane.operators import classifier, lexicon, lookup, rows, stats, termindex
from factlane.operators.retrieval import Scoring, score_totals, top_documents
from factlane.operators.substrings import build_substring_index, find_substrings
from factlane.plans import classify_qa, dispatch, generation, ingest, retrieval_qa, rule_qa
from factlane.scale import durable, scratch_path, spread_small
from factlane.schemas import KB_COLUMNS
from factlane.sources import city_csv, index_store, tables
from factlane.streaming import answers
from factlane.training_set import TRAINING_TEXTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Tag rules for prose in four languages, in the form of the attraction rules.
PROSE_TAGS = {
    " the ": ["english", "article"],
    " and ": ["english", "conjunction"],
    " und ": ["german", "conjunction"],
    " der ": ["german", "article"],
    " le ": ["french", "article"],
    " des ": ["french", "article"],
    " el ": ["spanish", "article"],
    " que ": ["romance", "conjunction"],
    "@": ["mail"],
    "http": ["link"],
}
# Which names to repair, and the city they are repaired in.
PART_REPAIRS = {"red widget": "红色部件", "blue bolt": "蓝色螺栓", "small ring": "小环", "green gear": "绿色齿轮"}
PART_REPAIR_CITY = "银川"


def named(name: str) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def register(function: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        return run

    return register


def query(function: Callable[[Tables], DataFrame]) -> Query:
    return named(function.__name__)(function)


def r6(column) -> Column:
    return F.round(column, 6)


# --- cleaning ----------------------------------------------------------------


@query
def clean_text(t: Tables) -> DataFrame:
    return t.raw_rows.select(
        "ord", clean.clean_text(F.col("raw_name")).alias("name"), clean.clean_text(F.col("raw_tips")).alias("tips")
    )


@query
def extract_labelled(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.extract_address(F.col("raw_address")).alias("address"))


@query
def extract_phone(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.extract_phone(F.col("raw_address")).alias("phone"))


@query
def extract_url_host(t: Tables) -> DataFrame:
    site = clean.extract_website(F.concat(F.lit("简介 官网： "), F.col("url"), F.lit(" 电话：1")))
    return t.pages.select("page_id", site.alias("website")).withColumn(
        "host", F.regexp_extract("website", "^https?://([^/?#]+)", 1)
    )


@query
def leading_name(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.clean_name(F.col("raw_name")).alias("name"))


@query
def range_cast(t: Tables) -> DataFrame:
    value = F.get_json_object("props", "$.k")
    return t.events.select("event_id", clean.range_number(value, 0, 50).alias("k"))


@query
def clean_rating(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.clean_rating(F.col("raw_rating")).alias("rating"))


@query
def price_floor(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.price_floor(F.col("raw_ticket")).alias("price"))


@query
def open_time(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.clean_open_time(F.col("raw_open")).alias("open_time"))


@query
def strip_label(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.clean_suggest_time(F.col("raw_suggest")).alias("suggest_time"))


@query
def keyword_tags(t: Tables) -> DataFrame:
    tags = F.array_join(clean.tag_array(F.col("text"), PROSE_TAGS), "|")
    return t.documents.select("doc_id", tags.alias("tags"))


@query
def attraction_tags(t: Tables) -> DataFrame:
    return t.raw_rows.select("ord", clean.extract_tags(F.col("raw_name"), F.col("raw_intro")).alias("tags"))


@query
def truncate_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", clean.truncate_text(F.col("text")).alias("text"))


# --- rows, lookups, statistics -----------------------------------------------


@query
def kb_build(t: Tables) -> DataFrame:
    return ingest.build_kb(t.raw_export)


@query
def dim_lookup(t: Tables) -> DataFrame:
    joined = rows.dim_lookup(t.raw_rows.select("ord", "city"), ingest.city_dimension(t.spark), "city", "province")
    return joined.select("ord", "city", "province")


def _repaired_parts(t: Tables) -> DataFrame:
    named = t.raw_rows.select("ord", "city").join(
        t.part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name")), "ord"
    )
    return rows.repair_values(
        named, ingest.repair_mapping(t.spark, PART_REPAIR_CITY, PART_REPAIRS), "city", "name"
    )


@query
def value_repair(t: Tables) -> DataFrame:
    return _repaired_parts(t).select("ord", "city", "name", "repaired")


@query
def value_repair_count(t: Tables) -> DataFrame:
    return rows.count_repaired(_repaired_parts(t))


@query
def union_missing_columns(t: Tables) -> DataFrame:
    suppliers = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    customers = t.customer.select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    return rows.union_all([suppliers, customers])


@query
def dedupe_first(t: Tables) -> DataFrame:
    return rows.keep_first(t.documents, ["text"], "doc_id").select("doc_id", "lang", "n_chars")


@query
def dense_ids(t: Tables) -> DataFrame:
    ordered = t.documents.select("doc_id", F.struct("n_chars", "doc_id").alias("place"))
    return rows.dense_ids(ordered, "place", "position").select("position", "doc_id")


@query
def head_rows(t: Tables) -> DataFrame:
    return rows.head_rows(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", 5)


@query
def topk_per_group(t: Tables) -> DataFrame:
    return rows.top_rated(t.kb, 3).select("city", "rank", "dataid", "name", "rating")


@query
def kb_stats(t: Tables) -> DataFrame:
    return stats.kb_stats(t.kb)


@query
def value_counts(t: Tables) -> DataFrame:
    return stats.value_counts(t.documents, "source")


@query
def entity_dictionary(t: Tables) -> DataFrame:
    return lexicon.entity_dictionary(t.kb)


@query
def equality_filter(t: Tables) -> DataFrame:
    return lookup.equals(t.documents, "lang", "de").select("doc_id", "source")


@query
def exact_lookup(t: Tables) -> DataFrame:
    return lookup.exact_lookup(t.requests, t.kb).fillna(0, ["dataid"])


@query
def fuzzy_lookup(t: Tables) -> DataFrame:
    return lookup.fuzzy_lookup(t.requests, t.kb).fillna(0, ["dataid"])


@query
def fuzzy_lookup_oneway(t: Tables) -> DataFrame:
    return lookup.fuzzy_lookup_one_way(t.requests, t.kb).fillna(0, ["dataid"])


# --- rule answers --------------------------------------------------------------


@query
def keyword_intent(t: Tables) -> DataFrame:
    return with_keyword_intent(t.questions).select("qid", "intent", r6("intent_confidence").alias("confidence"))


@named("intent_description")
def intent_description_lookup(t: Tables) -> DataFrame:
    return with_keyword_intent(t.questions).select("qid", intent_description(F.col("intent")).alias("description"))


def _joined(column: str):
    return F.array_join(column, "|").alias(column)


@query
def entity_match(t: Tables) -> DataFrame:
    found = lexicon.recognise(t.questions, lexicon.entity_index(t.kb))
    return found.select("qid", _joined("names"), _joined("cities"), _joined("provinces"))


@query
def entity_match_two_kinds(t: Tables) -> DataFrame:
    kinds = ("name", "city")
    found = lexicon.recognise(t.questions, lexicon.entity_index(t.kb, kinds), kinds)
    return found.select("qid", _joined("names"), _joined("cities"))


def _passages(t: Tables):
    return build_substring_index(t.benchmark.select(F.col("text").alias("value"), "item_id"))


@query
def passage_match(t: Tables) -> DataFrame:
    return find_substrings(t.documents, _passages(t), key="doc_id").select("doc_id", "item_id")


@query
def entity_match_blocked(t: Tables) -> DataFrame:
    """The way for dictionaries too large to send around, forced."""
    return find_substrings(t.documents, _passages(t), key="doc_id", broadcast=False).select("doc_id", "item_id")


@query
def city_recommend(t: Tables) -> DataFrame:
    return rule_qa.city_recommendations(t.kb)


@query
def slot_fill(t: Tables) -> DataFrame:
    return rule_qa.slot_fill(t.questions, t.kb)


@query
def render_answer(t: Tables) -> DataFrame:
    """Every question in both styles; no answer where the text before 的 is no name."""
    known = with_keyword_intent(t.questions)
    asked = known.select("qid", "intent", F.substring_index("text", "的", 1).alias("wanted"))
    requests = durable(lookup.exact_lookup(asked, t.kb).join(known.select("qid", "intent"), "qid"))
    styles = [
        rule_qa.render_answers(requests, t.kb, style).withColumn("style", F.lit(style)) for style in ("rules", "classifier")
    ]
    return rows.union_all(styles)


def _flat_rules(answered: DataFrame) -> DataFrame:
    return answered.select(
        "qid",
        "intent",
        r6("intent_confidence").alias("confidence"),
        F.array_join("entities.names", "|").alias("names"),
        F.array_join("entities.cities", "|").alias("cities"),
        F.array_join("entities.provinces", "|").alias("provinces"),
        "answer",
        "matched",
    )


@named("rule_qa")
def rule_qa_answers(t: Tables) -> DataFrame:
    return _flat_rules(rule_qa.rule_qa(t.questions, t.kb))


@query
def stream_rule_qa(t: Tables) -> DataFrame:
    """Conversation turns as a file stream, each micro-batch answered by the rules."""
    asked = t.arriving("conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        F.concat("text", F.lit(" NATION_"), (F.col("conv_id") % 25).cast("string"), F.lit("怎么样？")).alias("text"),
    )
    target, checkpoint = scratch_path(t.spark, "answers"), scratch_path(t.spark, "stream")
    answers.stream_rule_qa(asked, t.kb, target, checkpoint).awaitTermination()
    return _flat_rules(answers.read_answers(t.spark, target))


# --- terms and retrieval --------------------------------------------------------


@query
def char_terms(t: Tables) -> DataFrame:
    return termindex.char_terms(t.documents, "doc_id", "text")


@query
def term_idf(t: Tables) -> DataFrame:
    found = termindex.term_idf(termindex.char_terms(t.documents, "doc_id", "text"), t.documents)
    return found.select("term", "df", "cf", r6("idf").alias("idf"))


@query
def index_postings(t: Tables) -> DataFrame:
    index = termindex.build_index(t.documents.select("doc_id", "text"), "text", RetrievalConfig().max_features)
    return index.postings().select("doc_id", "term", r6("weight").alias("weight"))


def _benchmark_search(t: Tables):
    asked = t.benchmark.select(F.col("item_id").alias("qid"), "text")
    index = termindex.build_index(t.documents.select("doc_id", "text"), "text", RetrievalConfig().max_features)
    return termindex.query_vectors(asked, "text", index.vocabulary), index.documents


@query
def cosine_scores(t: Tables) -> DataFrame:
    """Every benchmark text against every document, as totals per text."""
    totals = score_totals(*_benchmark_search(t), Scoring(min_score=-1.0))
    return totals.select(
        F.col("qid").alias("item_id"), "n_docs", F.round("sum_score", 4).alias("sum_score"),
        r6("max_score").alias("max_score"),
    )


@query
def retrieve_topk(t: Tables) -> DataFrame:
    hits = top_documents(*_benchmark_search(t), Scoring(3, RetrievalConfig().min_score))
    return hits.select(F.col("qid").alias("item_id"), "rank", "doc_id", r6("score").alias("score"))


@query
def retrieve_topk_tiled(t: Tables) -> DataFrame:
    """The way for queries too many to send around, forced."""
    hits = top_documents(*_benchmark_search(t), Scoring(3, RetrievalConfig().min_score), broadcast=False)
    return hits.select(F.col("qid").alias("item_id"), "rank", "doc_id", r6("score").alias("score"))


@query
def index_roundtrip(t: Tables) -> DataFrame:
    """The search of a stored index of ids: made of two thirds of the documents, the others appended, then merged."""
    path, config = scratch_path(t.spark, "index"), RetrievalConfig()
    documents, late = t.documents.select("doc_id", "text"), F.pmod("doc_id", F.lit(3)) == 2
    index_store.append(documents.where(~late), path, "text", columns=[])
    index_store.append(documents.where(late), path, "text", columns=[])
    index_store.compact(t.spark, path)
    index = index_store.open_index(t.spark, path, config)
    asked = t.benchmark.select(F.col("item_id").alias("qid"), "text")
    vectors = termindex.query_vectors(asked, "text", index.vocabulary)
    hits = top_documents(vectors, index.in_ranges(), Scoring(config.top_k, config.min_score))
    return hits.select(F.col("qid").alias("item_id"), "rank", "doc_id", r6("score").alias("score"))


@query
def row_documents(t: Tables) -> DataFrame:
    return retrieval_qa.row_documents(t.kb)


@query
def entity_boost(t: Tables) -> DataFrame:
    return retrieval_qa.entity_boosts(t.questions, t.kb).select("kind", "value", "doc_id", r6("weight").alias("weight"))


@query
def question_boost(t: Tables) -> DataFrame:
    return retrieval_qa.question_boosts(t.questions, t.kb).select("qid", r6("max_boost").alias("max_boost"))


def _hits(t: Tables) -> DataFrame:
    return retrieval_qa.hybrid_hits(t.questions, t.kb)


@query
def hybrid_topk(t: Tables) -> DataFrame:
    index = retrieval_qa.document_index(t.kb)
    hits = retrieval_qa.retrieve(t.questions, index, lexicon.entity_index(t.kb))
    return hits.select("qid", "rank", "doc_id", r6("score").alias("score"))


@query
def hybrid_topk_stored(t: Tables) -> DataFrame:
    """The same search in a stored index of two segments, opened twice: the second time nothing is made anew."""
    path, late = scratch_path(t.spark, "index"), F.pmod("dataid", F.lit(4)) == 1
    retrieval_qa.stored_document_index(t.kb.where(~late), path)
    retrieval_qa.add_to_index(t.kb.where(late), path)
    retrieval_qa.stored_document_index(t.kb, path)
    index = retrieval_qa.stored_document_index(t.kb, path)
    hits = retrieval_qa.retrieve(t.questions, index, lexicon.entity_index(t.kb))
    return hits.select("qid", "rank", "doc_id", r6("score").alias("score"))


@query
def hybrid_topk_tiled(t: Tables) -> DataFrame:
    """The ways for large tables, forced: tiles of queries and documents, a shuffled substring join."""
    hits = retrieval_qa.retrieve(
        t.questions, retrieval_qa.document_index(t.kb), lexicon.entity_index(t.kb), broadcast=False
    )
    return hits.select("qid", "rank", "doc_id", r6("score").alias("score"))


@query
def score_breakdown(t: Tables) -> DataFrame:
    parts = retrieval_qa.score_breakdown(_hits(t))
    return parts.select(
        "qid", "rank", "name", "city", *[r6(c).alias(c) for c in ("score", "tfidf_score", "entity_boost")]
    )


@query
def hit_preview(t: Tables) -> DataFrame:
    return _hits(t).select(
        "qid", "rank", "name", clean.percent(F.round("score", 6)).alias("percent"),
        clean.preview(F.col("content")).alias("preview"),
    )


@query
def prompt_table(t: Tables) -> DataFrame:
    return retrieval_qa.prompts(t.questions, _hits(t))


@query
def template_answer(t: Tables) -> DataFrame:
    return retrieval_qa.template_answers(t.questions, _hits(t))


def _echo(prompt_rows: DataFrame, config: RetrievalConfig) -> DataFrame:
    """A generator in plain expressions: some answers, some failures of each sort."""
    kind = F.col("qid") % 4
    return prompt_rows.select(
        "qid",
        F.when(kind == 0, F.concat(F.lit("回答"), F.col("qid").cast("string")))
        .when(kind == 1, F.lit("调用失败: 500"))
        .when(kind == 2, F.lit("稍后")).alias("generated"),
        F.when(kind == 2, F.lit("error: timeout")).otherwise(F.lit("ok")).alias("status"),
    )


@query
def answer_fallback(t: Tables) -> DataFrame:
    hits = _hits(t)
    generated = retrieval_qa.generate(
        retrieval_qa.prompts(t.questions, hits), RetrievalConfig(provider="Echo"), {"echo": _echo}
    )
    return retrieval_qa.with_fallback(generated, retrieval_qa.template_answers(t.questions, hits))


@query
def batch_generate(t: Tables) -> DataFrame:
    """Prompts through a batch function in Python workers, as a model client would run."""

    def complete(batch: pd.DataFrame, config: RetrievalConfig) -> pd.Series:
        return "收到" + batch["prompt"].str.len().astype(str) + "字"

    made = retrieval_qa.generate(
        retrieval_qa.prompts(t.questions, _hits(t)),
        RetrievalConfig(provider="counter"),
        {"counter": retrieval_qa.from_batches(complete)},
    )
    return made.select("qid", "generated", "status")


@query
def batch_generate_durable(t: Tables) -> DataFrame:
    """Prompts one by one, with retries, twice: the second call asks only what the first could not answer.

    Lengths divisible by five get no answer in the first call, those divisible by three none at the first try.
    """

    def asking(word: str, down: bool):
        def ask(system_prompt: str, prompt: str, config: RetrievalConfig, attempt: int) -> str:
            if (down and len(prompt) % 5 == 0) or (attempt == 0 and len(prompt) % 3 == 0):
                raise RuntimeError("busy")
            return f"{word}{len(prompt)}字"

        return generation.from_requests(ask, generation.RequestPolicy(retries=1, backoff=0.001))

    asked, path = durable(retrieval_qa.prompts(t.questions, _hits(t))), scratch_path(t.spark, "answers")
    generation.generate_durably(asked, asking("收到", down=True), path, rounds=2)
    return generation.generate_durably(asked, asking("再收到", down=False), path, rounds=2)


@query
def rag_qa(t: Tables) -> DataFrame:
    answered = retrieval_qa.retrieval_qa(t.questions, t.kb)
    return answered.select(
        "qid", "question", F.size("retrieved_docs").cast("long").alias("n_docs"),
        F.array_join(F.transform("retrieved_docs", lambda d: d["doc_id"].cast("string")), "|").alias("doc_ids"),
        F.length("prompt").cast("long").alias("prompt_length"), "answer", "use_llm", "intent",
        r6("intent_confidence").alias("confidence"), F.array_join("entities.names", "|").alias("names"), "matched",
    )


# --- classification -------------------------------------------------------------


@query
def word_terms(t: Tables) -> DataFrame:
    return termindex.word_terms(t.documents, "doc_id", "text")


@query
def word_bigrams(t: Tables) -> DataFrame:
    return termindex.word_bigrams(t.documents, "doc_id", "text")


def _counted(t: Tables) -> DataFrame:
    return durable(termindex.with_word_counts(spread_small(t.documents.select("doc_id", "text")), "text").drop("text"))


def _vocabulary(counted: DataFrame) -> DataFrame:
    config = ClassifierConfig()
    terms = termindex.term_idf(termindex.count_rows(counted, "doc_id"), counted)
    return termindex.prune_vocabulary(terms, counted, config.max_features, config.min_df, config.max_df)


@query
def vocab_prune(t: Tables) -> DataFrame:
    return _vocabulary(_counted(t)).select("term", "df", "cf")


@query
def tfidf_sublinear(t: Tables) -> DataFrame:
    counted = _counted(t)
    vocabulary = durable(termindex.numbered(_vocabulary(counted)))
    weighted = termindex.with_vectors(counted, vocabulary, sublinear=True)
    return termindex.postings(weighted, vocabulary, "doc_id").select("doc_id", "term", r6("weight").alias("weight"))


@query
def question_terms(t: Tables) -> DataFrame:
    return termindex.word_and_pair_terms(t.questions, "qid", "text")


@query
def label_rows(t: Tables) -> DataFrame:
    return classifier.label_counts(t.labelled)


@query
def stratified_split(t: Tables) -> DataFrame:
    labelled = t.documents.select("doc_id", F.col("lang").alias("label"))
    return classifier.stratified_split(labelled, "doc_id")


@query
def class_weights(t: Tables) -> DataFrame:
    return classifier.class_weights(t.labelled).select("label", "n", r6("weight").alias("weight"))


def _rule_predictions(t: Tables) -> DataFrame:
    text = F.col("text")
    guess = (
        F.when(text.contains(" the "), "en").when(text.contains(" und "), "de")
        .when(text.contains(" le "), "fr").when(text.contains(" el "), "es").otherwise("xx")
    )
    return t.documents.select(F.col("lang").alias("label"), guess.alias("predicted"))


@query
def confusion_matrix(t: Tables) -> DataFrame:
    return classifier.confusion_matrix(_rule_predictions(t))


@query
def classification_report(t: Tables) -> DataFrame:
    report = classifier.classification_report(_rule_predictions(t))
    return report.select(
        "label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support", r6("accuracy").alias("accuracy")
    )


@query
def softmax_confidence(t: Tables) -> DataFrame:
    scores = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select(
        "vec_id",
        classifier.argmax(scores).cast("long").alias("best"),
        r6(classifier.softmax_confidence(scores)).alias("confidence"),
    )


def _languages(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("lang").alias("label"), "text")


def _turns(t: Tables) -> DataFrame:
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")


@query
def svm_predict(t: Tables) -> DataFrame:
    """Trained on the documents' languages and applied to them and to every conversation turn.

    Per language: its documents and whether nine in ten were recognised; and the
    turns, and whether each got one of the languages with a confidence it can have.
    """
    model = classifier.train(_languages(t), "doc_id")
    own = classifier.predict(_languages(t), model, "doc_id")
    languages = F.array(*[F.lit(x) for x in model.labels])
    sound = F.array_contains(languages, F.col("predicted")) & F.col("confidence").between(1 / len(model.labels) - 1e-9, 1.0)
    turns = classifier.predict(_turns(t), model).agg(F.count("*").alias("n"), F.bool_and(sound).alias("good"))
    per_language = own.groupBy("label").agg(F.count("*").alias("n"), (classifier.accuracy(own) >= 0.9).alias("good"))
    return per_language.unionByName(turns.select(F.lit("turns").alias("label"), "n", "good"))


@query
def svm_evaluate(t: Tables) -> DataFrame:
    """The hold-out's report.  Its numbers come from an iterated fit, so it has no SQL; tests compare with an exact solver."""
    _, report, _ = classifier.evaluate(_languages(t), "doc_id")
    return report.select("label", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query
def svm_save_load(t: Tables) -> DataFrame:
    """A model in memory against the same model stored and loaded, over every conversation turn."""
    path = scratch_path(t.spark, "model")
    labelled = t.labelled.select(F.col("doc_id").alias("example_id"), "label", "text")
    trained = classifier.train(labelled, "example_id")
    trained.save(path)
    loaded = classifier.load_or_train(t.spark, path)
    first = classifier.predict(_turns(t), trained).select("qid", F.col("predicted").alias("a"), F.col("confidence").alias("x"))
    second = classifier.predict(_turns(t), loaded).select("qid", F.col("predicted").alias("b"), F.col("confidence").alias("y"))
    same = F.col("a").eqNullSafe(F.col("b")) & (F.abs(F.col("x") - F.col("y")) < 1e-9)
    return first.join(second, "qid", "full").agg(F.count("*").alias("n_turns"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_different"))


@query
def classification_qa(t: Tables) -> DataFrame:
    """Entities and matches; and whether each answer is the predicted intent's template for the first name."""
    answered = durable(classify_qa.classification_qa(t.questions, t.kb))
    asked = answered.where(F.size("entities.names") > 0)
    requests = asked.select("qid", "intent", F.get("entities.names", F.lit(0)).alias("wanted"))
    found = lookup.exact_lookup(requests, t.kb).join(requests.select("qid", "intent"), "qid")
    expected = rule_qa.render_answers(found, t.kb, "classifier").select("qid", F.col("answer").alias("expected"))
    described = intent_description(F.col("intent")) == F.col("intent_description")
    return answered.join(expected, "qid", "left").select(
        "qid", F.array_join("entities.names", "|").alias("names"), F.array_join("entities.cities", "|").alias("cities"),
        "matched", F.when(F.size("entities.names") > 0, F.col("answer") == F.col("expected")).alias("as_predicted"),
        F.when(F.size("entities.names") == 0, F.col("answer")).alias("other_answer"),
        (described & F.col("intent_confidence").between(0, 1)).alias("sound"),
    )


@query
def compare_methods(t: Tables) -> DataFrame:
    """All methods side by side, every column of each.

    The classifier's intent depends on its training: it is checked to be one of the labels, and its answer to
    be the template of that intent for the first name, or the answer that needs no name.
    """
    compared = durable(dispatch.compare_methods(t.questions, t.kb))
    asked = compared.where("classification_matched IS NOT NULL AND rules_matched IS NOT NULL")
    known = lexicon.recognise(asked.select("qid", "text"), lexicon.entity_index(t.kb, ("name", "city")), ("name", "city"))
    named_ = known.where(F.size("names") > 0).select("qid", F.get("names", F.lit(0)).alias("wanted"))
    found = lookup.exact_lookup(named_, t.kb).join(compared.select("qid", F.col("classification_intent").alias("intent")), "qid")
    expected = rule_qa.render_answers(found, t.kb, "classifier").select("qid", F.col("answer").alias("expected"))
    labels = F.array(*[F.lit(x) for x in sorted(TRAINING_TEXTS)])
    return compared.join(expected, "qid", "left").select(
        "qid", "text", *[f"{m}_{c}" for m in ("rules", "retrieval") for c in ("intent", "matched", "answer")],
        "classification_matched", F.array_contains(labels, F.col("classification_intent")).alias("classification_intent_known"),
        F.when(F.col("expected").isNotNull(), F.col("classification_answer") == F.col("expected")).alias("classification_as_predicted"),
        F.when(F.col("expected").isNull(), F.col("classification_answer")).alias("classification_other_answer"),
    )


@query
def intent_examples(t: Tables) -> DataFrame:
    """The labelled examples of each intent that the given questions ask for by keyword."""
    asked = with_keyword_intent(t.questions).groupBy("intent").agg(F.count("*").alias("n_questions"))
    examples = classifier.label_counts(classifier.label_rows(t.spark)).withColumnsRenamed({"label": "intent", "n": "n_examples"})
    return asked.join(examples, "intent", "left").fillna(0, ["n_examples"])


# --- files ------------------------------------------------------------------------


RAW_SHORT = ["name", "address", "rating", "ticket", "open_time", "suggest", "intro", "tips"]


@F.pandas_udf(T.StringType())
def _gbk_bytes_as_latin(cells: pd.Series) -> pd.Series:
    return cells.map(lambda c: None if c is None else c.encode("gbk").decode("latin-1"))


def _write_export(rows_of_city: DataFrame, path: str, gbk: bool) -> None:
    if gbk:
        rows_of_city = rows_of_city.select(
            *[_gbk_bytes_as_latin(F.col(c)).alias(c.encode("gbk").decode("latin-1")) for c in rows_of_city.columns]
        )
    rows_of_city.write.options(
        header=True, escape='"', quoteAll=True, encoding="ISO-8859-1" if gbk else "UTF-8",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


OTHER_CITY = "其他"


@query
def ingest_encodings(t: Tables) -> DataFrame:
    """All raw rows written as one export per city, half in UTF-8 and half in GBK, and read back.

    Cities without a mapping share an export.  Beside these stand an export that is
    missing, one in neither encoding, and one with a malformed row, which give no
    rows.  GBK has no narrow yen sign, so the wide one stands for it.
    """
    folder = scratch_path(t.spark, "exports")
    entries = {f"export{i}": city for i, city in enumerate([*CITY_PROVINCE, OTHER_CITY])}
    place = F.when(F.col("city").isin(list(CITY_PROVINCE)), F.col("city")).otherwise(F.lit(OTHER_CITY))
    texts = [F.translate(c, "¥", "￥").alias(c) for c in RAW_COLUMNS]
    rows_ = t.raw_export.select(place.alias("city"), F.concat(F.col("ord").cast("string"), F.lit("号")).alias("编号"), *texts)
    for i, (entry, city) in enumerate(entries.items()):
        _write_export(rows_.where(F.col("city") == city).drop("city"), f"{folder}/{entry}", gbk=i % 2 == 1)
    few = rows_.drop("city")
    few.select(F.concat(F.encode("编号", "UTF-8"), F.lit(b"\xff\xfe\x80")).cast("string").alias("value")).write.text(f"{folder}/unreadable")
    header = ",".join(few.columns)
    cells = ",".join(["1"] * len(few.columns))
    t.nation.limit(1).select(F.lit(f"{header}\n{cells}\n{cells},2\n{cells}").alias("value")).write.text(f"{folder}/malformed")
    asked = {**entries, "missing": "失", "unreadable": "码", "malformed": "错"}
    read = city_csv.read_city_files(t.spark, folder, asked, ["编号", *RAW_COLUMNS])
    texts = [F.col(c).alias(short) for short, c in zip(RAW_SHORT, RAW_COLUMNS)]
    return read.select(F.regexp_extract("编号", r"^(\d+)", 1).cast("long").alias("ord"), "city", *texts)


@query
def kb_csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "kb")
    tables.write_kb_csv(t.kb.select(*KB_COLUMNS), path)
    return tables.read_kb_csv(t.spark, path)
