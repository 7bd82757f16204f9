"""Registry of the training-data queries and their SQL oracles."""

from __future__ import annotations

from strandloom.llm.queries import op01, op02, op03, op04, op05, op06, op07, op08, op09, op10

QUERIES = {
    "op1_pii": op01.op1_pii,
    "op2_topk_search": op02.op2_topk_search,
    "op3_toxicity": op03.op3_toxicity,
    "op4_mixing": op04.op4_mixing,
    "op5_html_text": op05.op5_html_text,
    "op6_byte_bpe": op06.op6_byte_bpe,
    "op7_sharding": op07.op7_sharding,
    "op8_embedding_neardup": op08.op8_embedding_neardup,
    "op9_simhash_neardup": op09.op9_simhash_neardup,
    "op10_language_id": op10.op10_language_id,
    "language_of_pages": op10.language_of_pages,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": op02.ORACLE,
    "op8_embedding_neardup": op08.ORACLE,
}
