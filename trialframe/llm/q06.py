"""Query op6_co_training_quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import table
from trialframe.llm.quality import score_quality, train


def op6_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "text_score", "meta_score", "score", "keep")
