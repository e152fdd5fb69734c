import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


KB_ROWS = [
    (1, "外滩", "上海", "上海", "中山东一路", None, "", 4.7, "免费", "全天开放", "2小时", "夜景", "黄浦江边的外滩。", ""),
    (2, "外滩观景台", "上海", "上海", "", "021-1", "http://a.cn", 4.7, "¥60起", "", None, "", "高处看外滩。", "早去"),
    (3, "豫园", "上海", "上海", "安仁街", "021-2,021-3", "", 4.9, "¥30起", "9:00-16:30", "半天", "园林", "明" * 310, "人多"),
    (4, "海宝塔", "银川", "宁夏", "", "", "", None, "", "", "", "古迹|历史", "", ""),
    (5, "外滩", "银川", "宁夏", "无", None, None, 3.0, "¥1起", None, None, None, None, None),
    (6, "镇北堡西部影视城", "银川", "宁夏", "镇北堡", "0951-1", "", 4.5, "¥80起", "8:00-18:00", "", "影视|娱乐", "电影拍摄地", "防晒"),
    (7, "沙湖", "固原", "宁夏", "", "", "", 5.0, "", "", "", "", "湖", ""),
    (8, "无名", None, "", "", "", "", 1.0, "", "", "", "", "", ""),
]
QUESTION_ROWS = [
    (1, "外滩的门票多少钱？"),
    (2, "银川有什么好玩的"),
    (3, "你好"),
    (4, "宁夏怎么样"),
    (5, ""),
    (6, "外滩观景台和豫园的评分"),
    (7, "海宝塔的电话号码"),
    (8, "上海 宁夏 固原"),
    (9, "豫园怎么样"),
    (10, None),
    (11, "沙湖在哪个城市"),
]


@pytest.fixture(scope="session")
def kb(spark):
    from factlane.schemas import KB_SCHEMA

    return spark.createDataFrame(KB_ROWS, KB_SCHEMA)


@pytest.fixture(scope="session")
def questions(spark):
    from factlane.schemas import QUESTION_SCHEMA

    return spark.createDataFrame(QUESTION_ROWS, QUESTION_SCHEMA)


def column(spark, function, values, kind="string"):
    """What ``function`` makes of each value, in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(values)), f"i long, v {kind}")
    return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]
