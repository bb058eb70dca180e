"""Query op1_language_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import table
from trialframe.llm.langid import identify


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from three quarters of the labelled texts, identify all of them."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, ~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "accepted")
