"""The pipeline's stages on the smallest given tables."""

import os

import pytest

import corpus_pipeline
import emberline.llm.queries  # noqa: F401
from emberline.llm import decontam, simhash
from emberline.llm.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= seen and ids
        seen = ids
        if name != "mixing":
            assert docs.columns == columns
        if name == "simhash near-dedup":
            assert simhash.similar_pairs(docs).count() == 0
        if name == "benchmark decontamination":
            assert decontam.contained_items(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_one_query_for_each_operation():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    from check_oracle import compare, duck

    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) is None


def test_mix_comes_in_training_order(spark):
    rows = QUERIES["op9_mixing"](spark, SF).collect()
    assert [(r.first_position is None, r.first_position or 0.0, r.doc_id) for r in rows] == sorted((r.first_position is None, r.first_position or 0.0, r.doc_id) for r in rows)
