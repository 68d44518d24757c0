"""The thirteen operators' queries under the names ``__spark_entry__`` registers, and their SQL."""

from __future__ import annotations

from . import exact_dedup, language_id, license_scan, minhash, mixing, quality, ranked_search, secret_scan, sentencepiece_codec, simhash, substring_dedup, token_store, vector_codes

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1,
    "op2_secret_scan": secret_scan.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_quality": quality.op4,
    "op5_language_id": language_id.op5,
    "op6_simhash": simhash.op6,
    "op7_minhash": minhash.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_mixing": mixing.op9,
    "op10_token_store": token_store.op10,
    "op11_license_scan": license_scan.op11,
    "op12_ranked_search": ranked_search.op12,
    "op13_vector_codes": vector_codes.op13,
}

ORACLE = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op7_minhash": minhash.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
