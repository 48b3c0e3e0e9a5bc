import importlib

import pytest

cp = pytest.importorskip("corpus_pipeline")


def test_stages_on_odd_rows(spark, corpus, nothing, tmp_path):
    from tidemill.llm.text import saved

    spark.createDataFrame([(1, "a b c d e f g h"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (corpus, nothing):
        docs = start
        for name, stage in cp.STAGES:
            last = name == cp.STAGES[-1][0]
            before = docs.count()
            docs = saved(stage(spark, docs, str(tmp_path)), name)
            if not last:
                assert docs.columns == start.columns and docs.count() <= before
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in start.select("doc_id").collect()}


def test_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
