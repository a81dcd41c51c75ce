"""The corpus pipeline, stage by stage."""

import corpus_pipeline
from quillspark.llm import decontamination, neardup
from quillspark.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] > 0.5 * sizes[0]
    assert docs.where("n_chars <> length(text)").count() == 0
    # what the filters are for is gone
    assert neardup.near_duplicates(docs).where("not kept").count() == 0
    assert decontamination.benchmark_matches(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    done = corpus_pipeline.encode_texts(spark, docs, SF)
    assert done.count() == sizes[-1] and done.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == sizes[-1]


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF))
    assert docs.count() == 0
