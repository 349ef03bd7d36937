import corpus_pipeline
from tests.llm.common import CLASHES, edge_docs, no_docs


def folder_of(spark, tmp_path):
    labels = spark.createDataFrame([(5, 1), (1, 0)], "doc_id long, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_edge_rows(spark, tmp_path):
    sf_dir, docs = folder_of(spark, tmp_path), edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == "clash" for r in rows for c in CLASHES), name
        assert stage(spark, no_docs(spark), sf_dir).collect() == [], name


def test_run_is_its_stages(spark, tmp_path):
    sf_dir = folder_of(spark, tmp_path)
    edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == {5}  # the only text of 50 words
    assert sorted(r.piece for r in got) == list(range(len(got)))
