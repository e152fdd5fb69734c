import pytest

from factlane.catalog.queries import QUERIES


@pytest.mark.parametrize("files", [1, 3])
def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path, files):
    def table(name, rows, schema):
        return spark.createDataFrame(rows, schema), str(tmp_path / f"{name}.parquet")

    for df, path in [
        table("region", [(0, "AFRICA")], "r_regionkey int, r_name string"),
        table("nation", [(i, f"NATION_{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        table("supplier", [(i, f"Supplier#{i:09d}", i % 3, 500.0) for i in range(6)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    ]:
        df.coalesce(1).write.parquet(path)
    turns, path = table(
        "conversations", [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in range(9) for t in range(4)],
        "conv_id long, turn int, role string, text string",
    )
    if files == 1:
        turns.toPandas().astype({"turn": "int32"}).to_parquet(path)
    else:
        turns.repartition(files).write.parquet(path)
    rows = QUERIES["stream_rule_qa"](spark, str(tmp_path)).collect()
    assert sorted(r["qid"] for r in rows) == [c * 1000 + t for c in range(9) for t in (0, 2)]
    assert {r["cities"] for r in rows} >= {"NATION_0", "NATION_1", "NATION_2"}
