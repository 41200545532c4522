"""The registered queries against SQL where it exists, and the pipeline stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import queries, toxicity
from fathomline.session import materialize
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op7_hilbert_packing"}))
def test_one_row_per_document(spark, name):
    assert queries.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns and out.count() <= before
        if name in ("decontamination", "pii"):
            assert out.count() == docs.count()
        docs, before = out, out.count()
    assert 0 < before < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_near_copy_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (2, text + " end"), (2, text + " end"), (5, None), (6, None), (7, ""), (None, "other words stand here now and then"), (8, "other words stand here now and then")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == sorted(["2", "5", "6", "7", "None"])


def test_toxicity_quality(spark):
    """Held-out rows that have a label, where one that always says 0 would find no toxic row at all."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.op2_compression_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    r = got.agg(F.count_if("predicted = 1 AND toxic = 1").alias("hit"), F.count_if("predicted = 1").alias("said"), F.count_if("toxic = 1").alias("toxic")).first()
    assert r.toxic > 50 and r.hit / r.toxic >= 0.85 and r.hit / r.said >= 0.9
    assert toxicity.fit_texts([], ["x"]) is None
