import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontam, queries, simhash

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.count() >= (1 if name.startswith("op4") else n)


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count(), name
        if name == "line_dedup":
            assert kept.count() == before.count()
        if name == "near_dedup":
            assert simhash.keep_one(kept).count() == kept.count()
        if name == "decontamination":
            assert decontam.occurrences(kept, bench).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first() == packed.agg(F.sum("length")).first()
