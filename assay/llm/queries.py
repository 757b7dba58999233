"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, chat_format, decontaminate, html_extract, language_id, near_dedup, pii, quality, sentencepiece_viterbi, suffix_dedup


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_quality": quality.op2_quality,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_ann": ann.op4_ann,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_sentencepiece": sentencepiece_viterbi.op6_sentencepiece,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_html_extract": html_extract.op8_html_extract,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat_format.ORACLE}
