import random

import pytest
from pyspark.sql import functions as F

from factlane.functions.intents import intent_description, with_keyword_intent
from factlane.operators import lexicon, lookup
from factlane.operators.substrings import build_substring_index, find_substrings
from factlane.schemas import SchemaError, require_columns, validate_kb
from tests.conftest import KB_ROWS, QUESTION_ROWS


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("filtered", [True, False])
@pytest.mark.parametrize("broadcast", [True, False])
def test_substrings_equal_brute_force(spark, broadcast, filtered):
    rng = random.Random(7)
    letters = "ab外😀"
    texts = {i: "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30, 63, 64, 65, 200]))) for i in range(60)}
    texts[60] = "a" * 300
    words = {"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 4, 7, 8, 15, 16, 17, 40]))) for _ in range(80)}
    words |= {texts[5][3:40], texts[7], "a" * 16, "a" * 64, "", "%", "zz"}
    dictionary = spark.createDataFrame([(w,) for w in words] + [(None,)], "value string")
    table = spark.createDataFrame(list(texts.items()) + [(99, None)], "qid long, text string")
    found = find_substrings(table, build_substring_index(dictionary), broadcast=broadcast, filtered=filtered)
    expected = sorted((i, w) for i, t in texts.items() for w in words if w and w in t)
    assert pairs(found, "qid", "value") == expected


@pytest.mark.parametrize("broadcast", [True, False])
def test_null_and_repeated_keys_are_rows_like_others(spark, broadcast):
    table = spark.createDataFrame([(None, "xaby"), (None, "ab"), (1, "ab"), (1, "cab"), (1, "ab")], "qid long, text string")
    dictionary = spark.createDataFrame([("ab", 7), ("ab", 8), ("c", 9)], "value string, n long")
    found = find_substrings(table, build_substring_index(dictionary), broadcast=broadcast)
    got = sorted(((r["qid"], r["value"], r["n"]) for r in found.collect()), key=str)
    expected = [(q, "ab", n) for q in (None, None, 1, 1, 1) for n in (7, 8)] + [(1, "c", 9)]
    assert got == sorted(expected, key=str)


def test_a_long_text_is_shuffled_once(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh", k=1_000_000))
    words = {long[i:i + 20] for i in range(0, 1_000_000, 10_000)} | {"h" * 30}
    index = build_substring_index(spark.createDataFrame([(w,) for w in words], "value string"))
    table = spark.createDataFrame([(1, long), (2, "x")], "qid long, text string")
    for filtered in (True, False):
        found = find_substrings(table, index, broadcast=False, filtered=filtered)
        assert {r.value for r in found.collect()} == {w for w in words if w in long}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # pieces leave their row without the text
        generated = [line for line in plan.split("\n") if "Generate explode" in line]
        assert len(generated) == 1 and "_text" not in generated[0]


@pytest.mark.parametrize("values, present", [(10, 2), (5000, 300)])
def test_filter_lets_every_anchor_through(spark, values, present):
    from factlane.operators import substrings

    index = build_substring_index(spark.createDataFrame([(f"value {i * 7919} of the dictionary",) for i in range(values)], "value string"))
    rows = index.entries.select("anchor", "hash").collect()
    for r in rows:
        assert r.hash == int(substrings.piece_hashes(r.anchor, (len(r.anchor),)).view("int64")[0])
        at = (r.hash % (1 << 64)) >> (64 - index.width)
        assert index.bits[at // 8] >> (at % 8) & 1
    assert sum(bin(b).count("1") for b in index.bits.tolist()) <= values


def test_all_columns_count_for_the_size(spark):
    wide = spark.createDataFrame([("ab", "x" * 100_000)] * 30, "value string, payload string")
    assert build_substring_index(wide).size.bytes > 3_000_000


def test_empty_dictionary_finds_nothing(spark):
    index = build_substring_index(spark.createDataFrame([("",)], "value string"))
    texts = spark.createDataFrame([(1, "x")], "qid long, text string")
    found = find_substrings(texts, index)
    assert found.count() == 0 and found.columns == ["qid", "value"]


def test_anchor_is_not_the_shared_prefix(spark):
    values = [(f"Attraction#{i:07d}",) for i in range(500)]
    index = build_substring_index(spark.createDataFrame(values, "value string"))
    most = index.entries.groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert most == 1


def test_dictionary_order_and_nulls(spark, kb):
    got = {(r["kind"], r["value"]): r["ord"] for r in lexicon.entity_dictionary(kb).collect()}
    assert got[("name", "外滩")] == 1 and got[("city", "银川")] == 4 and got[("province", "宁夏")] == 4
    assert ("city", None) not in got and got[("province", "")] == 8


def test_recognise_follows_table_order(spark, kb, questions):
    rows = {r["qid"]: r for r in lexicon.recognise(questions, lexicon.entity_index(kb)).collect()}
    assert len(rows) == len(QUESTION_ROWS)
    names = [r[1] for r in KB_ROWS]
    for qid, text in QUESTION_ROWS:
        expected = [n for n in dict.fromkeys(names) if text and n in text]
        assert rows[qid]["names"] == expected
    assert rows[6]["names"] == ["外滩", "外滩观景台", "豫园"] and rows[6]["first_name_ord"] == 1
    assert rows[8]["cities"] == ["上海", "固原"] and rows[8]["provinces"] == ["上海", "宁夏"]
    assert rows[3]["names"] == [] and rows[3]["first_name_ord"] is None


def test_keyword_intents(spark, questions):
    rows = {r["qid"]: (r["intent"], r["intent_confidence"]) for r in with_keyword_intent(questions).collect()}
    assert rows[1] == ("ASK_TICKET", 3 / 11)
    assert rows[4] == ("ASK_INTRO", 1 / 16)  # shared keyword: the earlier intent
    assert rows[5] == rows[10] == ("UNKNOWN", 0.0)
    assert rows[7] == ("ASK_PHONE", 2 / 9)
    assert rows[11][0] == "ASK_ADDRESS"  # one hit each: the earlier intent
    assert all(0 <= c <= 1 for _, c in rows.values())


def test_intent_description(spark):
    df = spark.createDataFrame([("ASK_TIPS",), ("NOPE",)], "intent string")
    assert [r[0] for r in df.select(intent_description(F.col("intent"))).collect()] == ["询问游玩贴士", "未知意图"]


def brute_fuzzy(wanted, both):
    for row in KB_ROWS:
        if both and row[1] == wanted:
            return row[0]
    for row in KB_ROWS:
        if wanted in row[1] or (both and row[1] in wanted):
            return row[0]
    return None


@pytest.mark.parametrize("both", [True, False])
def test_fuzzy_lookup_equals_brute_force(spark, kb, both):
    wanted = ["外滩", "外滩观景", "去豫园玩", "沙", "西部", "塔", "", "不存在", "银川外滩观景台", "无名氏", "滩"]
    requests = spark.createDataFrame(list(enumerate(wanted)) + [(50, None)], "qid long, wanted string")
    found = lookup.fuzzy_lookup(requests, kb) if both else lookup.fuzzy_lookup_one_way(requests, kb)
    got = {r["qid"]: r["dataid"] for r in found.collect()}
    assert got.pop(50) is None
    assert got == {i: brute_fuzzy(w, both) for i, w in enumerate(wanted)}


def test_exact_lookup_takes_first_row(spark, kb):
    requests = spark.createDataFrame([(i, w) for i, w in enumerate(["外滩"] * 40 + ["沙", None])], "qid long, wanted string")
    got = {r["qid"]: r["dataid"] for r in lookup.exact_lookup(requests, kb).collect()}
    assert len(got) == 42 and all(got[i] == 1 for i in range(40)) and got[40] is None and got[41] is None


def test_filter_reaches_the_scan(spark, kb, tmp_path):
    path = str(tmp_path / "kb")
    kb.write.parquet(path)
    plan = lookup.equals(spark.read.parquet(path), "city", "上海")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(city,上海)" in plan


def test_missing_columns_are_reported(spark, kb):
    assert validate_kb(kb) is kb
    with pytest.raises(SchemaError, match="rating"):
        validate_kb(kb.drop("rating"))
    with pytest.raises(SchemaError):
        require_columns(kb, ["nope"])
