"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from stockspark.llm import (decontaminate, licenses, maxent_lm, near_dup, pii, quality, sentence_pieces,
                            source_mix, spelling, substring_dup, token_rollup, token_store, vector_codes)

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_token_store": token_store.op2,
    "op3_licenses": licenses.op3,
    "op4_pii": pii.op4,
    "op5_quality": quality.op5,
    "op6_substring_dedup": substring_dup.op6,
    "op7_sentence_pieces": sentence_pieces.op7,
    "op8_near_dup": near_dup.op8,
    "op9_token_rollup": token_rollup.op9,
    "op10_maxent_lm": maxent_lm.op10,
    "op11_source_mix": source_mix.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op3_licenses": licenses.OP3_SQL,
    "op5_quality": quality.OP5_SQL,
    "op9_token_rollup": token_rollup.OP9_SQL,
    "op11_source_mix": source_mix.OP11_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
