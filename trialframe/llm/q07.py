"""Query op7_learned_partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import table
from trialframe.llm.partitions import search


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
