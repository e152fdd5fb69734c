import csv
import io

import pytest

from factlane import rule_qa
from factlane.constants import RAW_COLUMNS
from factlane.plans import ingest
from factlane.schemas import KB_COLUMNS
from factlane.sources.city_csv import read_city_files
from factlane.sources.tables import read_kb, read_kb_csv, write_kb, write_kb_csv
from factlane.streaming import answers


def export(path, rows, encoding, header=RAW_COLUMNS):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(header)
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


SHANGHAI = [
    ["外滩The Bund", "地址：中山路\n电话：021-1，021-2\n官网：http://b.cn x", "4.7", "免费", "全天", "建议游览时间：2小时", '夜景"好"，建筑', "早去\n人多"],
    ["", "", "", "", "", "", "", ""],
    ["豫园 Yu", "", "9", "{'成人': '¥40', '儿童': '¥20'}", "nan", "", "寺", "NA"],
    ["外滩Again", "", "1", "", "", "", "", ""],
]
YINCHUAN = [["海宝塔 Pagoda", "地址：北塔巷\n", "4", "", "9:00-17:00", "", "塔，丁丂", ""], ["外滩x", "", "", "", "", "", "", ""]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("exports")
    export(base / "上海.csv", SHANGHAI, "utf-8-sig")
    export(base / "银川.csv", YINCHUAN, "gbk")
    export(base / "海口.csv", [["火山公园", "4.1"]], "utf-8", ["名字", "评分"])
    export(base / "固原.csv", [["须弥山石窟", "5"]], "gb2312", ["名字", "评分"])
    (base / "景德镇.csv").write_bytes("名字,评分\n".encode() + b"\xff\xff\x80,1\n")
    return str(base)


CITIES = {"上海.csv": "上海", "银川.csv": "银川", "海口.csv": "海口", "固原.csv": "固原", "呼和浩特.csv": "呼和浩特", "景德镇.csv": "景德镇"}


def test_read_all_encodings(spark, folder):
    rows = read_city_files(spark, folder, CITIES).orderBy("ord").collect()
    assert [(r["名字"], r["city"]) for r in rows] == [
        ("外滩The Bund", "上海"), (None, "上海"), ("豫园 Yu", "上海"), ("外滩Again", "上海"),
        ("海宝塔 Pagoda", "银川"), ("外滩x", "银川"), ("火山公园", "海口"), ("须弥山石窟", "固原"),
    ]
    assert rows[0]["小贴士"] == "早去\n人多" and rows[0]["介绍"] == '夜景"好"，建筑'
    assert rows[4]["地址"] == "地址：北塔巷\n" and rows[4]["介绍"] == "塔，丁丂"
    assert rows[2]["开放时间"] is None and rows[2]["小贴士"] is None
    assert rows[6]["地址"] is None and rows[6]["评分"] == "4.1"


def test_nothing_to_read(spark, tmp_path):
    empty = read_city_files(spark, str(tmp_path), {"a.csv": "上海"})
    assert empty.isEmpty() and empty.columns == [*RAW_COLUMNS, "city", "ord"]
    report = ingest.ingest(spark, str(tmp_path), {"a.csv": "上海"}, str(tmp_path / "kb"))
    assert report == {"rows": 0, "per_city": {}, "written": False}


def test_ingest_job(spark, folder, tmp_path):
    target, exported = str(tmp_path / "kb"), str(tmp_path / "csv")
    report = ingest.ingest(spark, folder, CITIES, target, exported)
    assert report == {"rows": 6, "per_city": {"上海": 2, "银川": 2, "海口": 1, "固原": 1}, "written": True}
    kb = read_kb(spark, target).orderBy("dataid").collect()
    assert [(r["dataid"], r["name"], r["province"]) for r in kb] == [
        (1, "外滩", "上海"), (2, "豫园", "上海"), (3, "海宝塔", "宁夏"), (4, "外滩", "宁夏"), (5, "火山公园", "海南"), (6, "须弥山石窟", "宁夏"),
    ]
    first = kb[0].asDict()
    assert first == {
        "dataid": 1, "name": "外滩", "city": "上海", "province": "上海", "address": "中山路", "phone": "021-1,021-2",
        "website": "http://b.cn", "rating": 4.7, "ticket_price": "免费", "open_time": "全天", "suggest_time": "2小时",
        "tags": "夜景|建筑", "description": '夜景"好"，建筑', "tips": "早去 人多",
    }
    assert kb[1]["ticket_price"] == "¥20起" and kb[1]["rating"] is None and kb[1]["tips"] == ""
    assert read_kb_csv(spark, exported).count() == 6


def test_kb_round_trips(spark, kb, tmp_path):
    write_kb_csv(kb, str(tmp_path / "csv"))
    back = {r["dataid"]: r for r in read_kb_csv(spark, str(tmp_path / "csv")).collect()}
    for row in kb.collect():
        assert [v or None for v in row] == [v or None for v in back[row["dataid"]]]
    write_kb(kb, str(tmp_path / "kb"), by_city=True)
    again = read_kb(spark, str(tmp_path / "kb"))
    assert again.columns == KB_COLUMNS and again.count() == 8
    plan = again.where("city = '上海'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city" in plan


def test_stream_equals_batch(spark, kb, questions, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        questions.where(f"qid % 3 = {i}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(questions.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    target = str(tmp_path / "out")
    answers.stream_rule_qa(stream, kb, target, str(tmp_path / "state")).awaitTermination()
    got = answers.read_answers(spark, target)
    assert got.select("batch").distinct().count() == 3
    flat = lambda df: sorted((r["qid"], r["answer"], r["matched"], r["intent"]) for r in df.collect() if r["qid"])
    key = lambda x: x[0]
    assert sorted(flat(got), key=key) == sorted(flat(rule_qa(questions, kb)), key=key)


def test_stream_intents_need_no_state(spark, questions, tmp_path):
    source = str(tmp_path / "in")
    questions.write.parquet(source)
    stream = spark.readStream.schema(questions.schema).parquet(source)
    query = answers.stream_intents(stream).writeStream.format("memory").queryName("intents").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["qid"]: r["intent"] for r in spark.table("intents").collect()}
    assert got[1] == "ASK_TICKET" and len(got) == 11
