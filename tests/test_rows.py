import math

from pyspark.sql import functions as F

from factlane.operators import rows, stats
from factlane.scale import salted_lookup


def test_keep_first_is_idempotent_and_null_safe(spark):
    data = [(i, k, c) for i, (k, c) in enumerate([("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), (None, "x"), ("b", None)])]
    df = spark.createDataFrame(data, "ord long, name string, city string").repartition(3)
    once = rows.keep_first(df, ["name", "city"], "ord")
    assert sorted(r["ord"] for r in once.collect()) == [0, 2, 3, 5]
    assert rows.keep_first(once, ["name", "city"], "ord").count() == 4


def test_one_hot_key_is_limited_before_the_shuffle(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    df = spark.range(1000).select(key.alias("k"), F.col("id").alias("ord"))
    kept = rows.keep_first(df, ["k"], "ord")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert kept.count() == 667


def test_dense_ids_follow_the_order(spark):
    df = spark.range(0, 997).select((F.col("id") * 7919 % 104729).alias("ord"), F.lit("x").alias("v")).repartition(5)
    got = [(r["dataid"], r["ord"]) for r in rows.dense_ids(df, "ord").orderBy("dataid").collect()]
    assert [i for i, _ in got] == list(range(1, 998))
    assert [o for _, o in got] == sorted(o for _, o in got)


def test_top_rated(spark, kb):
    got = [(r["city"], r["rank"], r["dataid"]) for r in rows.top_rated(kb, 2).where("city is not null").collect()]
    assert sorted(got) == sorted([("上海", 1, 3), ("上海", 2, 1), ("银川", 1, 6), ("银川", 2, 5), ("固原", 1, 7)])


def test_top_rated_puts_nan_last(spark):
    df = spark.createDataFrame([(1, "a", math.nan), (2, "a", 1.0), (3, "a", None)], "dataid long, city string, rating double")
    assert [r["dataid"] for r in rows.top_rated(df, 3).orderBy("rank").collect()] == [2, 1, 3]


def test_union_and_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "i long, a string")
    b = spark.createDataFrame([("y", 2)], "b string, i long")
    got = {r["i"]: (r["a"], r["b"]) for r in rows.union_all([a, b]).collect()}
    assert got == {1: ("x", None), 2: (None, "y")}
    assert rows.with_columns_or_null(a, ["a", "z"]).first().asDict() == {"a": "x", "z": None}


def test_repair_only_within_its_city(spark):
    from factlane.plans.ingest import repair_kb

    kb = spark.createDataFrame(
        [(1, "Haibao Pagoda", "银川"), (2, "Haibao Pagoda", "上海"), (3, "Other", "银川"), (4, None, "银川")],
        "dataid long, name string, city string",
    )
    fixed = repair_kb(kb)
    got = {r["dataid"]: (r["name"], r["repaired"]) for r in fixed.collect()}
    assert got == {1: ("海宝塔", True), 2: ("Haibao Pagoda", False), 3: ("Other", False), 4: (None, False)}
    assert tuple(rows.count_repaired(fixed).first()) == (1, 4)


def test_statistics(spark, kb):
    assert tuple(stats.kb_stats(kb).first()) == (8, 3, 3)
    counted = [tuple(r) for r in stats.value_counts(kb, "city").collect()]
    assert counted == [("上海", 3), ("银川", 3), ("固原", 1)]
    assert stats.is_empty(kb.where("dataid < 0")) and not stats.is_empty(kb)
    assert [r["dataid"] for r in rows.head_rows(kb, "dataid", 3).collect()] == [1, 2, 3]


def test_salted_lookup_keeps_every_fact(spark):
    facts = spark.range(200).select(
        "id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    dim = spark.createDataFrame([("hot", 1), ("2", 2)], "k string, v long")
    got = {r["id"]: r["v"] for r in salted_lookup(facts, dim, "k", F.col("id")).collect()}
    assert len(got) == 200
    assert all(got[i] == (None if i % 3 == 0 else 1 if i % 3 == 1 else (2 if i == 2 else None)) for i in range(200))
