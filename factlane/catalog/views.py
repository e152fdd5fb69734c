"""The roles the operators need, derived from the given tables.

Each role is one SELECT that Spark and DuckDB both understand, so a query and
its check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlane.constants import RAW_COLUMNS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations", "events",
)

# A supplier is an attraction, its nation the city, its region the province.
# Every tenth name is cut by a character, so that it lies inside other names.
KB = """
SELECT s_suppkey + 1 AS dataid,
       CASE WHEN s_suppkey % 10 = 7 THEN substr(s_name, 1, 17) ELSE s_name END AS name,
       n_name AS city,
       r_name AS province,
       CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat(n_name, '大道', CAST(s_suppkey AS STRING), '号') END AS address,
       CASE WHEN s_suppkey % 3 = 0 THEN CAST(NULL AS STRING)
            ELSE concat('021-', lpad(CAST(s_suppkey AS STRING), 8, '0')) END AS phone,
       concat('http://', lower(n_name), '.example.org/', CAST(s_suppkey AS STRING)) AS website,
       CASE WHEN s_acctbal >= 0 AND s_acctbal < 10200 THEN floor(s_acctbal / 200) / 10 END AS rating,
       CASE s_suppkey % 5 WHEN 0 THEN '免费' WHEN 1 THEN ''
            ELSE concat('¥', CAST(s_suppkey % 90 + 10 AS STRING), '起') END AS ticket_price,
       concat(CAST(s_suppkey % 4 + 7 AS STRING), ':00-', CAST(s_suppkey % 5 + 16 AS STRING), ':30') AS open_time,
       CASE WHEN s_suppkey % 6 = 5 THEN CAST(NULL AS STRING)
            ELSE concat(CAST(s_suppkey % 6 + 1 AS STRING), '小时') END AS suggest_time,
       CASE s_suppkey % 3 WHEN 0 THEN '公园|自然' WHEN 1 THEN '博物馆|历史' ELSE '' END AS tags,
       CASE WHEN s_suppkey % 6 = 0 THEN CAST(NULL AS STRING)
            WHEN s_suppkey % 6 = 1 THEN concat(s_name, '：', repeat('山水相连，四季皆景。', 40))
            ELSE concat(s_name, '位于', r_name, '的', n_name, '，余额', CAST(CAST(floor(s_acctbal) AS INTEGER) AS STRING),
                        '，是很受欢迎的景点。') END AS description,
       CASE WHEN s_suppkey % 2 = 0 THEN '请提前预约' ELSE '' END AS tips
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

# A customer asks one question about a supplier, a nation, a region or nothing.
QUESTIONS = """
SELECT c_custkey AS qid,
       CASE c_custkey % 11
         WHEN 0 THEN concat('请问', wanted, '的门票多少钱？')
         WHEN 1 THEN concat(wanted, '的开放时间是什么时候？')
         WHEN 2 THEN concat('给我介绍一下', wanted)
         WHEN 3 THEN concat(wanted, '在哪里？怎么去？')
         WHEN 4 THEN concat(n_name, '有什么好玩的景点推荐？')
         WHEN 5 THEN concat(wanted, '的评分和口碑怎么样？')
         WHEN 6 THEN concat(wanted, '和', other, '哪个更值得去吗，在哪个城市')
         WHEN 7 THEN '今天天气好吗'
         WHEN 8 THEN concat(r_name, '旅游有什么攻略和注意事项')
         WHEN 9 THEN concat(wanted, '适合玩多久？电话是多少，官网网址呢？')
         ELSE concat(n_name, '的', wanted, '是什么类型')
       END AS text
FROM (SELECT c_custkey, c_nationkey,
             concat('Supplier#', lpad(CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING), 9, '0')) AS wanted,
             concat('Supplier#', lpad(CAST(c_custkey % 97 AS STRING), 9, '0')) AS other
      FROM customer) AS c
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

# Names to look up: exact, cut short, or with something added.
REQUESTS = """
SELECT c_custkey AS qid,
       CASE c_custkey % 4
         WHEN 0 THEN concat('Supplier#', lpad(CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING), 9, '0'))
         WHEN 1 THEN substr(concat('Supplier#', lpad(CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING), 9, '0')), 2, 15)
         WHEN 2 THEN concat('Supplier#', lpad(CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING), 9, '0'), '分店')
         ELSE concat('lier#', lpad(CAST(CAST(floor(c_custkey / 14) AS BIGINT) AS STRING), 9, '0'))
       END AS wanted
FROM customer
"""

# A part is one row of a raw city export.
RAW_ROWS = """
SELECT p_partkey AS ord,
       CASE p_partkey % 7 WHEN 0 THEN '上海' WHEN 1 THEN '银川' WHEN 2 THEN '海口' WHEN 3 THEN '固原'
            WHEN 4 THEN '呼和浩特' WHEN 5 THEN '景德镇' ELSE '未知市' END AS city,
       CASE p_partkey % 6
         WHEN 0 THEN concat('外滩', CAST(p_size AS STRING), '号The Bund')
         WHEN 1 THEN concat(p_name, ' ', chr(10), ' 海宝塔')
         WHEN 2 THEN concat('　 古镇', CAST(p_size AS STRING), '　')
         WHEN 3 THEN concat('博物馆（', CAST(p_size % 7 AS STRING), '）', p_name)
         WHEN 4 THEN concat('山湖公园·', p_type, ' Park')
         ELSE CASE WHEN p_partkey % 12 = 5 THEN ' 　 ' END
       END AS raw_name,
       CASE p_partkey % 5
         WHEN 0 THEN concat('地址：', p_brand, '路', CAST(p_size AS STRING), '号', chr(10), '电话：021-',
                            CAST(p_partkey AS STRING), '，  400-', CAST(p_size AS STRING), chr(10),
                            '官网：https://part', CAST(p_partkey AS STRING), '.example.com/a?b=1 更多')
         WHEN 1 THEN concat('地址: ', p_type, '电力路', CAST(p_size AS STRING), '号　电话: ', CAST(p_partkey AS STRING), ' , 110')
         WHEN 2 THEN concat('  ', p_name, '　路口  ', chr(10), '官网:http://x.example.org')
         WHEN 3 THEN concat('地址：　电话：，', CAST(p_size AS STRING), '，')
         ELSE CASE WHEN p_partkey % 10 = 4 THEN '' END
       END AS raw_address,
       CASE p_partkey % 9
         WHEN 0 THEN CAST(p_size / 10 AS STRING) WHEN 1 THEN '5.1' WHEN 2 THEN 'abc' WHEN 3 THEN 'nan'
         WHEN 4 THEN '-1' WHEN 5 THEN ' 4.5 ' WHEN 6 THEN '1e0' WHEN 7 THEN concat(CAST(p_size % 6 AS STRING), '.')
       END AS raw_rating,
       CASE p_partkey % 7
         WHEN 0 THEN concat('{成人: ¥', CAST(p_size + 50 AS STRING), ', 儿童: ¥', CAST(p_size AS STRING), '}')
         WHEN 1 THEN '全年 免费 开放' WHEN 2 THEN '{}' WHEN 3 THEN 'nan' WHEN 4 THEN concat('约', CAST(p_size AS STRING), '元　起')
         WHEN 5 THEN concat('票价¥', CAST(p_partkey AS STRING), ' 或 ¥99')
       END AS raw_ticket,
       CASE p_partkey % 6
         WHEN 0 THEN concat('周一至周日 ', CAST(p_size % 12 AS STRING), ':00-17:30')
         WHEN 1 THEN concat(repeat('法定节假日另行通知，', 12), CAST(p_size % 12 AS STRING), '：30 至 18:00 最后入园')
         WHEN 2 THEN concat(repeat('四季开放，', 25), '全天') WHEN 3 THEN repeat('请咨询景区　', 20) WHEN 4 THEN 'nan'
       END AS raw_open,
       CASE p_partkey % 4
         WHEN 0 THEN concat('建议游览时间：　', CAST(p_size % 8 AS STRING), ' - ', CAST(p_size % 8 + 1 AS STRING), '小时')
         WHEN 1 THEN '建议游览时间半天' WHEN 2 THEN '  1天 '
       END AS raw_suggest,
       CASE p_partkey % 5
         WHEN 0 THEN concat(p_name, repeat(' 温泉与森林，瀑布和峡谷。', p_size))
         WHEN 1 THEN concat('动物与水族，', p_name, '，夜景建筑，', repeat('长', p_size * 20))
         WHEN 2 THEN concat('陶瓷老街', chr(10), p_brand) WHEN 3 THEN p_type
       END AS raw_intro,
       CASE p_partkey % 3 WHEN 0 THEN concat('请提前', chr(10), chr(10), '预约　', p_brand, '  ') WHEN 1 THEN '' END AS raw_tips
FROM part
"""

RAW_RENAMES = dict(zip(
    ["raw_name", "raw_address", "raw_rating", "raw_ticket", "raw_open", "raw_suggest", "raw_intro", "raw_tips"],
    RAW_COLUMNS,
))

# A user's turn in a conversation is a question as well; it asks about the nation its number picks.
TURNS = """
SELECT conv_id * 1000 + turn AS qid, concat(text, ' NATION_', CAST(conv_id % 25 AS STRING), '怎么样？') AS text
FROM conversations WHERE role = 'user'
"""


class Tables:
    """The given tables and the roles derived from them, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)

    def arriving(self, name: str) -> DataFrame:
        """A table's files as a stream, one a batch; by a pattern, as a table is one file or a folder of them."""
        files = self.spark.readStream.schema(getattr(self, name).schema).option("maxFilesPerTrigger", 1)
        return files.parquet(f"{self.folder}/{name}.parque[t]")

    def select(self, sql: str) -> DataFrame:
        """Runs one of the role statements over this folder's tables."""
        for name in TABLES:
            if re.search(rf"\b{name}\b", sql):
                getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(sql)

    @property
    def kb(self) -> DataFrame:
        return self.select(KB)

    @property
    def questions(self) -> DataFrame:
        return self.select(QUESTIONS)

    @property
    def requests(self) -> DataFrame:
        return self.select(REQUESTS)

    @property
    def raw_rows(self) -> DataFrame:
        return self.select(RAW_ROWS)

    @property
    def raw_export(self) -> DataFrame:
        """The raw rows under the column names of an export."""
        return self.raw_rows.withColumnsRenamed(RAW_RENAMES)

    @property
    def turns(self) -> DataFrame:
        return self.select(TURNS)

    @property
    def labelled(self) -> DataFrame:
        """Documents with a quality/toxic label and a prediction by a fixed rule."""
        labels = self.labels.select(
            "doc_id", F.concat_ws("-", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("label")
        )
        return self.documents.select("doc_id", "text").join(labels, "doc_id")
