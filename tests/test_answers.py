import pytest
from pyspark.sql import functions as F

from factlane import answer, compare_methods, rule_qa
from factlane import constants as C
from factlane.functions.render import by_intent, fill, value_or_missing
from factlane.plans.rule_qa import city_recommendations, render_answers, slot_fill


@pytest.fixture(scope="module")
def answered(questions, kb):
    return {r["qid"]: r for r in rule_qa(questions, kb).collect()}


def test_name_answers(answered):
    assert answered[1]["answer"] == "【外滩】的门票价格为：免费"
    assert answered[1]["matched"] == "外滩" and answered[1]["slots"] == {"name": "外滩", "ticket_price": "免费"}
    assert answered[6]["answer"] == "【外滩】的用户评分为：4.7 分（满分5分）"
    assert answered[7]["answer"] == "【海宝塔】的联系电话为：暂无信息"
    assert answered[9]["answer"].startswith("【豫园】景点简介：\n明明")


def test_city_answer(answered):
    assert answered[2]["answer"] == (
        "为您推荐银川的热门景点：\n1. 【镇北堡西部影视城】- 评分：4.5\n2. 【外滩】- 评分：3.0\n3. 【海宝塔】- 评分：暂无信息"
    )
    assert answered[2]["matched"] == "城市推荐" and answered[2]["slots"] == {}
    assert answered[8]["answer"].startswith("为您推荐上海的热门景点：")


def test_help_answer(answered):
    for qid in (3, 4, 5, 10):  # a province alone is recognised but answers nothing
        assert answered[qid]["answer"] == C.RULE_HELP and answered[qid]["matched"] is None
    assert answered[4]["entities"]["provinces"] == ["宁夏"]
    assert len(answered) == 11


def test_slots_per_intent(spark, questions, kb):
    got = {}
    for r in slot_fill(questions, kb).collect():
        got.setdefault(r["qid"], {})[r["field"]] = r["value"]
    assert got[11] == {"name": "沙湖", "address": "暂无信息", "city": "固原", "province": "宁夏"}


def test_city_recommendations_rank(kb):
    got = {r["city"]: r["recommendation"] for r in city_recommendations(kb, 1).collect()}
    assert got["上海"] == "为您推荐上海的热门景点：\n1. 【豫园】- 评分：4.9"


def test_styles_differ(spark, kb):
    requests = spark.createDataFrame([(1, "ASK_RATING", 1), (2, "SOMETHING", 6)], "qid long, intent string, dataid long")
    rules = {r["qid"]: r["answer"] for r in render_answers(requests, kb).collect()}
    classifier = {r["qid"]: r["answer"] for r in render_answers(requests, kb, "classifier").collect()}
    assert rules[1].endswith("（满分5分）") and classifier[1] == "【外滩】的用户评分为：4.7 分"
    assert rules[2] == "关于【镇北堡西部影视城】，这里是它的基本介绍：\n电影拍摄地"
    assert classifier[2] == "关于【镇北堡西部影视城】：电影拍摄地"


def test_template_without_its_slot_apologises(spark):
    df = spark.createDataFrame([("X", "n")], "intent string, name string")
    text = by_intent(F.col("intent"), {"name": F.col("name"), "phone": F.lit("1")}, {"X": "{name}{phone}"}, "{name}", {"X": ["name"]})
    assert df.select(text).first()[0] == "关于【n】：暂时无法获取您询问的具体信息。"


def test_missing_values(spark):
    df = spark.createDataFrame([("", None, float("nan"), 4.0)], "a string, b string, c double, d double")
    got = df.select(*[value_or_missing(df, c) for c in ("a", "b", "c", "d", "nope")]).first()
    assert list(got) == [C.MISSING] * 3 + ["4.0", C.MISSING]
    assert df.select(fill("x{d}y{{}}", {"d": F.col("d")})).first()[0] == "x4.0y{}"


def test_dispatch(questions, kb):
    assert answer(questions, kb, "rules").columns[:2] == ["qid", "text"]
    with pytest.raises(ValueError):
        answer(questions, kb, "guess")


def test_compare_methods(questions, kb, trained):
    rows = {r["qid"]: r for r in compare_methods(questions, kb, trained).collect()}
    assert len(rows) == 11
    assert rows[1]["rules_answer"] == "【外滩】的门票价格为：免费"
    assert rows[1]["classification_intent"] == "ASK_TICKET"
    assert rows[1]["retrieval_matched"] == "外滩"


@pytest.fixture(scope="module")
def trained(spark):
    from factlane.plans.classify_qa import intent_model

    return intent_model(spark)


def test_classification_answers(questions, kb, trained):
    from factlane import classification_qa

    rows = {r["qid"]: r for r in classification_qa(questions, kb, trained).collect()}
    assert rows[1]["answer"] == "【外滩】的门票价格为：免费" and rows[1]["intent_description"] == "询问门票价格"
    assert rows[2]["matched"] == "城市推荐"
    assert rows[4]["answer"] == C.CLASSIFIER_HELP and rows[4]["entities"]["provinces"] == []
    assert all(0 < r["intent_confidence"] <= 1 for r in rows.values())
