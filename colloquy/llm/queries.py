"""The corpus operators' registered queries and their DuckDB twins."""

from __future__ import annotations

from colloquy.llm import bpe_queue, decontamination, exact_dedup, language_id, licenses, line_dedup, ngram_join, sentencepiece_rounds, sharding, spelling_variants, token_frames, vector_codes, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_token_frames": token_frames.op3_token_frames,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_language_id": language_id.op6_language_id,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_sentencepiece": sentencepiece_rounds.op8_sentencepiece,
    "op9_licenses": licenses.op9_licenses,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_bpe": bpe_queue.op13_bpe,
}
ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_ngram_join": ngram_join.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
    "op11_spelling_variants": spelling_variants.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
