"""Query op13_token_files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialframe.llm.common import table
from trialframe.llm.tokenfiles import token_report, write_tokens


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to flat files, map the files into memory, report."""
    import public_tokenizers

    folder = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_report(spark, folder)
