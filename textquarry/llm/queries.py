"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, html_extraction, jaccard, language_id, line_dedup, media, merkle, mixing, packing, simhash, suffix_dedup, token_counts, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_html_extraction": html_extraction.op3_html_extraction,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_media_columns": media.op5_media_columns,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_ngram_jaccard": jaccard.op13_ngram_jaccard,
}
ORACLE_SQL = {"op1_line_dedup": line_dedup.OP1_SQL, "op9_mixing": mixing.OP9_SQL, "op12_merkle_manifest": merkle.OP12_SQL}
