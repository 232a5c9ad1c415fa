from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from phenoline.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF_DIR, "labels").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF_DIR)
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum(labels[i] for i in ids if i in labels) >= 0.95 * sum(labels.values())
    lines = corpus_pipeline.line_dedup(spark, kept, SF_DIR)
    assert {r["doc_id"] for r in lines.collect()} == ids
    single = corpus_pipeline.near_duplicates(spark, docs, SF_DIR)
    texts = [r["text"] for r in single.collect()]
    assert len({" ".join(t.split()).lower() for t in texts}) == len(texts) and len(texts) < len(before)
    for stage in (kept, lines, single, corpus_pipeline.mix_sources(spark, docs, SF_DIR)):
        assert tuple(stage.columns) == corpus_pipeline.COLUMNS
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).union(docs.limit(0))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF_DIR).collect()
        stage(spark, docs.limit(0), SF_DIR).collect()
