"""Registered corpus queries against their oracles, and the pipeline."""

import pytest

import corpus_pipeline
from geoloom.llm import registry
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = registry.queries()["op2_language_id"](spark, SF).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_pipeline_keeps_the_columns_and_shrinks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
