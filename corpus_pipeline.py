"""A training corpus from raw documents: filter, deduplicate, mix and pack.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import jaccard, mixing, packing, quality, substring
from trialframe.llm.common import store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that co-training holds for good; the rejected ones go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select(COLUMNS), model).where("keep").select(COLUMNS)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Five-word shingles, similarity 0.8 or more.  Documents without words are no copies of each
    other.  doc_id is a key: of repeated rows one stays; rows without an id stay.
    """
    found = jaccard.near_duplicates(docs, n=5, percent=80)
    ids = store(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    docs = docs.select(COLUMNS)
    once = docs.join(ids.where("n = 1").select("doc_id"), "doc_id", "left_semi")
    more = docs.join(ids.where("n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more).unionByName(docs.where("doc_id is null")).select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of 13 words or more that an earlier document has.

    An untouched text stays as it is, of others the kept words are joined by one blank; a
    document of which no word is left goes.
    """
    out = substring.remove_repeats(docs.select(COLUMNS)).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return out.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def temperature_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The evenest mix in which no source is passed more than 4 times; none is cut.

    Up to about four passes, repeated text is worth nearly as much as new text (Muennighoff et
    al. 2023); sources that differ by less than that are mixed in equal parts.
    """
    return mixing.mix_sources(docs.select(COLUMNS), max_repeat=4.0, keep_all=True).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier), ("ngram_jaccard", ngram_jaccard),
    ("substring_dedup", substring_dedup), ("temperature_mixing", temperature_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: a trained classifier and a tokenizer are not expressible; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
