"""Queries and oracle SQL of this package's operators, for __spark_entry__.py."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, exact_dedup, language_id, pii, quality, simhash, substring_dedup, url_filter

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_language_id": language_id.op2_language_id,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality": quality.op8_quality,
    "op9_simhash": simhash.op9_simhash,
    "op10_pii": pii.op10_pii,
}

ORACLE_SQL = {
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
}
