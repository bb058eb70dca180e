"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from trialframe.llm import q01, q02, q03, q04, q05, q06, q07, q08, q09, q10, q11, q12, q13

QUERIES = {
    "op1_language_id": q01.op1_language_id,
    "op2_substring_dedup": q02.op2_substring_dedup,
    "op3_best_fit_packing": q03.op3_best_fit_packing,
    "op4_temperature_mixing": q04.op4_temperature_mixing,
    "op5_ngram_jaccard": q05.op5_ngram_jaccard,
    "op6_co_training_quality": q06.op6_co_training_quality,
    "op7_learned_partitions": q07.op7_learned_partitions,
    "op8_warc": q08.op8_warc,
    "op9_hnsw_near_dedup": q09.op9_hnsw_near_dedup,
    "op10_url_reputation": q10.op10_url_reputation,
    "op11_conversation_repair": q11.op11_conversation_repair,
    "op12_whitening": q12.op12_whitening,
    "op13_token_files": q13.op13_token_files,
}
ORACLES = {
    "op4_temperature_mixing": q04.ORACLE, "op8_warc": q08.ORACLE, "op10_url_reputation": q10.ORACLE,
}
