"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from tessera.llm.common import materialize


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, sf_dir), "test")
        sizes.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[4] < sizes[3] and sizes[5] == sizes[4]
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids))
    assert sorted(ids) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect())


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
