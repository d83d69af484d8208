"""A corpus without labels keeps its documents in the language stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import make


def test_only_texts_without_a_letter_go(spark):
    docs = make(spark, ["plain words", "123 !!", "", None, "日本語", "é"]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 4, 5]
