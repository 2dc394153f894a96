from __future__ import annotations

from pathlib import Path

import pytest

from graphbatch.llm.queries import oracle_sql, queries
from tests.oracle import expected, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got, want = queries()[name](spark, SF).toPandas(), expected(SF, oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_each_operator_has_a_query():
    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}


def test_pipeline_stages_agree_with_run(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert {x.doc_id for x in out.select("doc_id").collect()} <= {x.doc_id for x in kept.select("doc_id").collect()}
        kept = out
    assert rows(kept.toPandas()) == rows(corpus_pipeline.run(spark, SF).toPandas())
