import corpus_pipeline
import pytest

from factlane.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_copies", "mixing", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns[: len(docs.columns)] == docs.columns
    ids = {r.doc_id for r in docs.collect()}
    got = out.collect()
    assert got and {r.doc_id for r in got} <= ids
    assert all(len((r.text or "").split()) >= 50 for r in got)


@pytest.mark.parametrize("empty", ["doc_id long, text string, lang string, source string, n_chars long"])
def test_stages_on_an_empty_table(spark, empty):
    docs = spark.createDataFrame([], empty)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.collect() == [] and out.columns == docs.columns


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
