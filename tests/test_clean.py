import pytest
from pyspark.sql import functions as F

from factlane.functions import clean
from tests.conftest import column


@pytest.mark.parametrize("value, expected", [
    (None, ""), ("", ""), ("  a \n\t b　 c ", "a b c"), ("　　", ""), (" x y　", "x y"),
])
def test_clean_text(spark, value, expected):
    assert column(spark, clean.clean_text, [value]) == [expected]


def test_address(spark):
    cases = {
        None: "", "": "",
        "地址：中山路1号\n电话：123": "中山路1号",
        "地址:　人民路　2号 电话：1": "人民路 2号",
        "上海 外滩": "上海 外滩",
        "地址：上海电力路1号": "上海",
        "地址：\n电话：1": "地址： 电话：1",
        "地址： 电话：1": "",
    }
    assert column(spark, clean.extract_address, list(cases)) == list(cases.values())


def test_address_strict_keeps_label_characters(spark):
    strict = lambda c: clean.extract_address(c, strict_labels=True)
    cases = {"地址：上海电力路1号 电话：5": "上海电力路1号", "地址：话剧院路\n官网：x": "话剧院路", "无标签": "无标签"}
    assert column(spark, strict, list(cases)) == list(cases.values())


def test_phone(spark):
    cases = {
        None: "", "无": "",
        "电话：021-123，400-1": "021-123,400-1",
        "电话:  5 6 ": "5,6",
        "电话：1 , 2": "1,,,2",
        "电话：，": "",
        "地址：x 电话：0951-6  官网：y": "0951-6",
    }
    assert column(spark, clean.extract_phone, list(cases)) == list(cases.values())


def test_website(spark):
    cases = {None: "", "官网：https://a.cn/x?y=1 后文": "https://a.cn/x?y=1", "官网: http://b.cn": "http://b.cn", "官网：www.c.cn": ""}
    assert column(spark, clean.extract_website, list(cases)) == list(cases.values())


def test_name(spark):
    cases = {
        None: "", "": "", "外滩The Bund": "外滩", "The Bund外滩": "The Bund外滩", " 外滩": "外滩",
        "豫园（南门）Yu": "豫园（南门）", "798艺术区": "798艺术区", "   ": "",
    }
    assert column(spark, clean.clean_name, list(cases)) == list(cases.values())


def test_rating(spark):
    values = ["4.5", "0", "5", "5.1", "-1", "abc", "nan", None, "", " 3. ", "1e0", "4d", "0x1", "inf", ".5"]
    expected = [4.5, 0.0, 5.0, None, None, None, None, None, None, 3.0, 1.0, None, None, None, 0.5]
    assert column(spark, clean.clean_rating, values) == expected


def test_price(spark):
    cases = {
        None: "", "": "", "nan": "", "{'成人': '¥120', '儿童': '¥60'}": "¥60起", "免费": "免费",
        "凭证免费入园 ¥5": "¥5起", "¥0": "¥0起", "{}": "{}", "{免费}": "免费", "¥起": "¥起", "约 60　元": "约 60 元",
        "¥１２": "¥12起", "¥9 ¥10": "¥9起", "¥98765432109876543210": "¥98765432109876543210起",
    }
    assert column(spark, clean.price_floor, list(cases)) == list(cases.values())


def test_open_time(spark):
    long = "请" * 101
    cases = {
        None: "", "nan": "", " 9:00-17:30 ": "9:00-17:30",
        "x" * 100 + "": "x" * 100,
        long + "9:00-17:30": "9:00-17:30", long + "8：30 至 18：00止": "8：30 至 18：00",
        long + "全天": "全天开放", long: long,
    }
    assert column(spark, clean.clean_open_time, list(cases)) == list(cases.values())


def test_suggest_time(spark):
    cases = {None: "", "建议游览时间：　2小时": "2小时", "建议游览时间半天": "半天", " 1  天": "1 天"}
    assert column(spark, clean.clean_suggest_time, list(cases)) == list(cases.values())


def test_tags(spark):
    df = spark.createDataFrame(
        [(1, "公园", "有山有湖"), (2, None, None), (3, "动物水族", "森林公园博物馆"), (4, "街", "x"), (5, "寺塔", None)],
        "i long, n string, t string",
    )
    got = [r[0] for r in df.orderBy("i").select(clean.extract_tags(F.col("n"), F.col("t"))).collect()]
    assert got == ["公园|自然|山岳|湖泊", "", "博物馆|历史|公园|自然|森林", "", "寺庙|宗教|古迹|历史"]


def test_truncate_counts_characters(spark):
    values = ["长" * 500, "长" * 501, "😀" * 501, None, " a  b "]
    assert column(spark, clean.truncate_text, values) == ["长" * 500, "长" * 500 + "...", "😀" * 500 + "...", "", "a b"]


def test_preview_and_percent(spark):
    assert column(spark, lambda c: clean.preview(c, 3), ["abc", "abcd", " a\n"]) == ["abc", "abc...", " a\n"]
    assert column(spark, clean.percent, [0.12345, 1.0], "double") == [12.3, 100.0]
    assert column(spark, clean.clamp_confidence, [0.2, 1.5], "double") == [0.2, 1.0]


def test_price_of_any_length(spark):
    long = "9" * 45
    assert column(spark, clean.price_floor, [f"¥{long}", f"¥{long} ¥007", "¥000"]) == [f"¥{long}起", "¥7起", "¥0起"]
