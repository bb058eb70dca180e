"""Query op11_conversation_repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import table
from trialframe.llm.turns import damage, repair


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage the conversations, plan their repair, report every conversation."""
    return repair(damage(table(spark, sf_dir, "conversations"))).report()
