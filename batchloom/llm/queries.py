"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from batchloom.llm import decontaminate, exact_dedup, html_text, langid, line_dedup, lm, minhash, pieces, pii, url_filter

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_lm_score": lm.op3,
    "op4_pii": pii.op4,
    "op5_pieces": pieces.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_minhash": minhash.op7,
    "op8_html_text": html_text.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_url_filter": url_filter.op10,
}

ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLES
