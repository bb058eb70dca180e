"""Query op5_ngram_jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import table
from trialframe.llm.jaccard import near_duplicates


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct 4-word shingles, similarity of 85 % or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)
