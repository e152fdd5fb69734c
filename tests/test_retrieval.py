import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factlane import RetrievalConfig, retrieval_qa
from factlane import constants as C
from factlane.operators import termindex
from factlane.operators.lexicon import entity_index
from factlane.operators.retrieval import Scoring, score_totals, top_documents
from factlane.plans import retrieval_qa as R
from factlane.sources.tables import read_index, read_postings, write_index
from tests.conftest import KB_ROWS, QUESTION_ROWS


def char_counts(text):
    counts = Counter()
    for word in (text or "").lower().split():
        padded = f" {word} "
        counts.update(padded)
        counts.update(padded[i:i + 2] for i in range(len(padded) - 1))
    return counts


def brute_index(texts, limit=5000):
    tf = {k: char_counts(t) for k, t in texts.items()}
    df, cf = Counter(), Counter()
    for counts in tf.values():
        df.update(counts.keys())
        cf.update(counts)
    vocabulary = sorted(cf, key=lambda t: (-cf[t], t))[:limit]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocabulary}
    return idf, {k: normal({t: n * idf[t] for t, n in c.items() if t in idf}) for k, c in tf.items()}


def normal(vector):
    length = math.sqrt(sum(w * w for w in vector.values()))
    return {t: w / length for t, w in vector.items()} if length else {}


def dot(a, b):
    return sum(w * b.get(t, 0.0) for t, w in a.items())


TEXTS = {1: "外滩 Ab", 2: "ab  AB\n外滩", 3: "", 4: None, 5: "　 x", 6: "长城 长城 长城"}


def test_char_terms_equal_brute_force(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["tf"] for r in termindex.char_terms(df, "doc_id", "text").collect()}
    assert got == {(k, t): n for k, text in TEXTS.items() for t, n in char_counts(text).items()}
    assert sum(n for (k, _), n in got.items() if k == 1) == 14


@pytest.mark.parametrize("limit", [5000, 6])
def test_index_equals_brute_force(spark, limit):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    index = termindex.build_index(df, "text", limit)
    idf, expected = brute_index(TEXTS, limit)
    assert {r["term"]: round(r["idf"], 9) for r in index.vocabulary.collect()} == {t: round(w, 9) for t, w in idf.items()}
    got = {(r["doc_id"], r["term"]): round(r["weight"], 9) for r in index.postings().collect()}
    assert got == {(k, t): round(w, 9) for k, v in expected.items() for t, w in v.items()}
    assert index.documents.count() == len(TEXTS)


def test_documents_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    index = termindex.build_index(docs, "text", 10)
    plan = termindex.with_vectors(termindex.with_char_counts(docs, "text"), index.vocabulary)
    tree = plan._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in tree and "Join" not in tree


def brute_hits(questions, kb_docs, k, threshold, boosts=True):
    """kb_docs: doc_id -> (name, city, province, content)"""
    idf, vectors = brute_index({d: c[3] for d, c in kb_docs.items()})
    names = list(dict.fromkeys(c[0] for c in kb_docs.values() if c[0]))
    cities = list(dict.fromkeys(c[1] for c in kb_docs.values() if c[1]))
    provinces = list(dict.fromkeys(c[2] for c in kb_docs.values() if c[2]))
    out = {}
    for qid, text in questions:
        text = text or ""
        q = normal({t: n * idf[t] for t, n in char_counts(text).items() if t in idf})
        hit_names, hit_cities, hit_provinces = ([v for v in vs if v in text] for vs in (names, cities, provinces))
        boost = {}
        for d, (name, city, _, content) in kb_docs.items():
            b = C.BOOST_CITY if city in hit_cities else 0
            b += C.BOOST_PROVINCE if any(p in content for p in hit_provinces) else 0
            if name in hit_names:
                b += C.BOOST_NAME
            elif any(n in name or name in n for n in hit_names):
                b += C.BOOST_NAME_PART
            boost[d] = b if boosts else 0
        any_boost = max(boost.values()) > 0
        scored = []
        for d in kb_docs:
            c = dot(q, vectors[d])
            scored.append((-round(0.3 * c + 0.7 * boost[d] if any_boost else c, 9), d))
        out[qid] = [(d, round(-s, 6)) for s, d in sorted(scored)[:k] if -s >= threshold]
    return out


def kb_documents(kb):
    texts = {r["doc_id"]: r["content"] for r in R.row_documents(kb).collect()}
    return {r[0]: (r[1], r[2], r[3], texts[r[0]]) for r in KB_ROWS}


def collected(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r["qid"], r["rank"])):
        out.setdefault(r["qid"], []).append((r["doc_id"], round(r["score"], 6)))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_hybrid_equals_brute_force(spark, kb, questions, broadcast):
    hits = R.retrieve(questions, R.document_index(kb), entity_index(kb), broadcast=broadcast)
    expected = brute_hits(QUESTION_ROWS, kb_documents(kb), 3, 0.1)
    assert collected(hits) == {q: h for q, h in expected.items() if h}


def test_both_ways_agree_on_random_texts_with_ties(spark, monkeypatch):
    from factlane.operators import ranges, retrieval

    monkeypatch.setattr(retrieval, "TILE_BYTES", 2000)
    monkeypatch.setattr(retrieval, "STEP_QUERIES", 7)
    monkeypatch.setattr(ranges, "RANGE_DOCUMENTS", 9)
    rng = random.Random(3)
    texts = {i: " ".join("".join(rng.choices("abcde", k=3)) for _ in range(rng.randint(0, 6))) for i in range(80)}
    texts.update({80 + i: texts[1] + " x" for i in range(40)})  # a third are copies
    asked = [(i, texts[i * 3]) for i in range(25)]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "qid long, text string")
    index = termindex.build_index(docs, "text", 5000)
    vectors = termindex.query_vectors(queries, "text", index.vocabulary)
    scoring = Scoring(4, 0.1)
    expected = brute_hits(asked, {d: ("", "", "", t) for d, t in texts.items()}, 4, 0.1, boosts=False)
    for broadcast in (True, False):
        assert collected(top_documents(vectors, index.documents, scoring, broadcast)) == {q: h for q, h in expected.items() if h}
    totals = [
        {r["qid"]: (r["n_docs"], round(r["sum_score"], 6), round(r["max_score"], 6)) for r in score_totals(vectors, index.documents, scoring, b).collect()}
        for b in (True, False)
    ]
    assert totals[0] == totals[1] and len(totals[0]) == 25


def test_boosts_are_complete(spark, kb, questions):
    docs = kb_documents(kb)
    names, cities, provinces = ({c[i] for c in docs.values() if c[i]} for i in range(3))
    asked = [text or "" for _, text in QUESTION_ROWS]
    weights = {}
    for d, (name, city, _, content) in docs.items():
        weights.update({("city", v, d): C.BOOST_CITY for v in cities if v == city and any(v in t for t in asked)})
        weights.update({("province", v, d): C.BOOST_PROVINCE for v in provinces if v in content and any(v in t for t in asked)})
        for v in names:
            if any(v in t for t in asked) and (v in name or name in v):
                weights["name", v, d] = C.BOOST_NAME if v == name else C.BOOST_NAME_PART
    got = [tuple(r) for r in R.entity_boosts(questions, kb).collect()]
    assert len(got) == len(set(got)) and {r[:3]: r[3] for r in got} == weights
    top = {r["qid"]: r["max_boost"] for r in R.question_boosts(questions, kb).collect()}
    assert len(top) == len(QUESTION_ROWS) and top[5] == top[10] == 0 and top[7] == C.BOOST_NAME


def test_hybrid_on_random_tables(spark):
    from factlane.schemas import KB_SCHEMA

    rng = random.Random(21)
    kb_rows, asked = [], []
    for i in range(60):
        name = "".join(rng.choices("甲乙丙丁", k=rng.randint(1, 3)))
        city, province = rng.choice(["城A", "城B", "城C"]), rng.choice(["省X", "省Y"])
        kb_rows.append((i, name, city, province, *[""] * 3, None, *[""] * 4, "".join(rng.choices("天地人和省X城A", k=8)), ""))
    for q in range(40):
        parts = [rng.choice(kb_rows)[rng.choice([1, 1, 2, 3])] for _ in range(rng.randint(0, 3))]
        asked.append((q, "的".join(parts) + rng.choice(["", "天地", "和人"])))
    kb = spark.createDataFrame(kb_rows, KB_SCHEMA)
    texts = {r["doc_id"]: r["content"] for r in R.row_documents(kb).collect()}
    docs = {r[0]: (r[1], r[2], r[3], texts[r[0]]) for r in kb_rows}
    expected = {q: h for q, h in brute_hits(asked, docs, 3, 0.1).items() if h}
    questions = spark.createDataFrame(asked, "qid long, text string")
    assert collected(R.retrieve(questions, R.document_index(kb), entity_index(kb))) == expected


def test_duplicate_questions_are_refused(spark, kb):
    twice = spark.createDataFrame([(1, "外滩"), (1, "豫园")], "qid long, text string")
    with pytest.raises(ValueError, match="unique"):
        R.retrieve(twice, R.document_index(kb), None)


def test_documents_have_all_lines(kb):
    rows = {r["doc_id"]: r for r in R.row_documents(kb).collect()}
    lines = rows[4]["content"].split("\n")
    assert len(lines) == 13 and lines[0] == "【景点名称】海宝塔" and lines[6] == "【用户评分】暂无信息"
    assert rows[1]["city"] == "上海"


def answer_of(spark, question, content, name="景"):
    df = spark.createDataFrame([(question, name, content)], "q string, n string, c string")
    return df.select(R.template_answer(F.col("q"), F.col("n"), F.col("c"))).first()[0]


def test_template_answer(spark):
    doc = "【门票价格】¥5】¥6\n【开放时间】暂无信息\n【景点简介】" + "好" * 301
    assert answer_of(spark, "开放时间和门票", doc) == "【景】的门票价格：¥6"
    assert answer_of(spark, "几点开", doc) == "抱歉，关于【景】的开放时间，目前暂无相关信息。"
    assert answer_of(spark, "电话", doc) == "关于【景】：\n" + "好" * 300 + "..."
    assert answer_of(spark, "随便", "【景点简介】短") == "关于【景】：\n短"
    assert answer_of(spark, "随便", "【景点简介】暂无信息").startswith("已找到【景】的相关信息")
    assert answer_of(spark, "介绍", "【景点简介】暂无信息") == "抱歉，关于【景】的景点简介，目前暂无相关信息。"


def test_prompt(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", "B"), (1, 1, "a", "A")], "qid long, rank int, name string, content string"
    )
    asked = spark.createDataFrame([(1, "问"), (2, "无")], "qid long, text string")
    rows = R.prompts(asked, hits).collect()
    assert len(rows) == 1
    assert "---文档1: a---\nA\n\n---文档2: b---\nB\n\n【用户问题】\n问" in rows[0]["prompt"]
    assert rows[0]["system_prompt"] == C.SYSTEM_PROMPT


def test_generators(spark):
    asked = spark.createDataFrame([(i, "s", "p" * i) for i in range(6)], "qid long, system_prompt string, prompt string")
    made = R.generate(asked, RetrievalConfig(provider="LEN"), {"len": R.from_batches(lambda b, config: b["prompt"].str.len().astype(str))})
    assert {r["qid"]: (r["generated"], r["status"]) for r in made.collect()}[3] == ("3", "ok")

    def broken(batch: pd.DataFrame, config):
        raise RuntimeError("down")

    def one_broken(batch: pd.DataFrame, config):
        if (batch["qid"] == 3).any():
            raise RuntimeError("bad row")
        return batch["qid"].astype(str) + f" at {config.temperature}"

    some = R.generate(asked, RetrievalConfig(provider="x", temperature=0.5), {"x": R.from_batches(one_broken)}).collect()
    assert {r["qid"]: (r["generated"], r["status"]) for r in some} == {
        **{i: (f"{i} at 0.5", "ok") for i in (0, 1, 2, 4, 5)}, 3: (None, "error: bad row")
    }

    failed = R.generate(asked, RetrievalConfig(provider="x"), {"x": R.from_batches(broken)}).collect()
    assert len(failed) == 6 and all(r["status"] == "error: down" and r["generated"] is None for r in failed)
    assert all(r["status"].startswith("error") for r in R.generate(asked, RetrievalConfig(provider="unheard of")).collect())


def test_fallback(spark):
    generated = spark.createDataFrame(
        [(1, "好", "ok"), (2, "调用失败", "ok"), (3, "好", "error"), (4, None, "ok"), (5, "无法连接到", "ok"), (6, "处理出错", "ok")],
        "qid long, generated string, status string",
    )
    templates = spark.createDataFrame([(i, f"t{i}") for i in range(1, 8)], "qid long, template string")
    got = {r["qid"]: (r["answer"], r["use_llm"]) for r in R.with_fallback(generated, templates).collect()}
    assert got == {1: ("好", True), **{i: (f"t{i}", False) for i in range(2, 8)}}


def test_full_answers(spark, kb, questions):
    rows = {r["qid"]: r for r in retrieval_qa(questions, kb).collect()}
    assert len(rows) == 11
    assert rows[5]["answer"] == C.NO_HIT_ANSWER and rows[5]["prompt"] == "" and rows[5]["retrieved_docs"] == []
    assert rows[9]["matched"] == "豫园" and rows[9]["retrieved_docs"][0]["entity_boost"] == 0.8
    for r in rows.values():
        assert len(r["retrieved_docs"]) <= 3 and all(d["score"] >= 0.1 for d in r["retrieved_docs"])
        assert [d["rank"] for d in r["retrieved_docs"]] == list(range(1, len(r["retrieved_docs"]) + 1))
    generated = retrieval_qa(
        questions, kb, RetrievalConfig(provider="ok", top_k=2), use_llm=True,
        registered={"ok": R.from_batches(lambda b, config: b["qid"].astype(str))},
    )
    made = {r["qid"]: r for r in generated.collect()}
    assert made[9]["answer"] == "9" and made[9]["use_llm"]
    assert len(rows[1]["retrieved_docs"]) == 3 and len(made[1]["retrieved_docs"]) == 2
    assert made[5]["answer"] == C.NO_HIT_ANSWER and not made[5]["use_llm"]


def test_stored_index_gives_the_same_hits(spark, kb, questions, tmp_path):
    index = R.document_index(kb)
    write_index(index, str(tmp_path / "index"), partitions=3)
    stored = read_index(spark, str(tmp_path / "index"))
    entities = entity_index(kb)
    assert collected(R.retrieve(questions, stored, entities)) == collected(R.retrieve(questions, index, entities))
    of_term = read_postings(spark, str(tmp_path / "index"), "外滩")
    assert sorted(r["doc_id"] for r in of_term.collect()) == sorted(d for d, c in kb_documents(kb).items() if "外滩" in c[3])


def test_config():
    config = RetrievalConfig()
    changed = config.updated(top_k=5, provider=None)
    assert (config.top_k, changed.top_k, changed.provider) == (3, 5, "offline")
    assert config.index_key("p") == changed.index_key("p") != config.updated(max_features=10).index_key("p")
    for bad in ({"top_k": 0}, {"min_score": 2}, {"max_features": 0}):
        with pytest.raises(ValueError):
            RetrievalConfig(**bad)


def test_ranges_below_the_kth_score_are_left_out(spark, monkeypatch):
    from factlane.operators import ranges
    from factlane.operators.retrieval import ranges_scored, search

    monkeypatch.setattr(ranges, "RANGE_DOCUMENTS", 8)
    rng = random.Random(5)
    # documents of ten kinds, each with terms of its own and some that all share
    rows = [(i, *zip(*sorted({(10 * (i % 10) + rng.randrange(10), 1.0) for _ in range(4)} | {(100 + rng.randrange(5), 0.3)}))) for i in range(800)]
    rows = [(i, list(t), [w / math.sqrt(sum(x * x for x in weights)) for w in weights]) for i, t, weights in rows]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<int>, weights array<double>")
    queries = docs.where("doc_id % 40 = 0").withColumnRenamed("doc_id", "qid")
    index = ranges.build_ranges(docs)
    assert sorted(d for r in index.select("doc_ids").collect() for d in r.doc_ids) == list(range(800))
    work = ranges_scored(queries, index, Scoring(3, 0.1)).collect()
    assert len(work) == 20 and all(r.n_ranges == index.count() for r in work)
    assert sum(r.n_scored for r in work) < 0.4 * sum(r.n_ranges for r in work)
    vectors = {i: dict(zip(t, w)) for i, t, w in rows}
    for hit in top_documents(queries, index, Scoring(1, 0.1)).collect():
        assert hit.doc_id == min(d for d in vectors if round(dot(vectors[hit.qid], vectors[d]), 9) == hit.score) and hit.score == pytest.approx(1)
    # whatever the cosine, documents of a lower boost are not looked at
    favoured = spark.createDataFrame([("nx", d, 0.8) for d in range(0, 800, 10)] + [("cy", d, 0.5) for d in range(800)], "value string, doc_id long, weight double")
    asked = queries.withColumn("asked", F.array(F.lit("nx"), F.lit("cy")))
    marked = ranges.with_marks(index, favoured)
    scoring = Scoring(3, 0.1, 0.3, 0.7)
    assert {r.boost for r in search(asked, marked, scoring).collect()} == {1.3}
    work = ranges_scored(asked, marked, scoring).collect()
    assert sum(r.n_scored for r in work) < 0.2 * sum(r.n_ranges for r in work)
