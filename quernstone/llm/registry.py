"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, chat, decontam, jaccard, langid, line_dedup, packing, quality, toxicity, wrappers

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_decontamination": decontam.query,
    "op3_quality_rules": quality.query,
    "op4_toxicity": toxicity.query,
    "op5_packed_tokens": packing.query,
    "op6_language_id": langid.query,
    "op7_html_extraction": wrappers.query,
    "op8_ngram_jaccard_join": jaccard.query,
    "op9_line_dedup": line_dedup.query,
    "op10_byte_bpe": bpe.query,
}
ORACLE_SQL = {
    "op1_chat_formatting": chat.SQL,
    "op3_quality_rules": quality.SQL,
    "op8_ngram_jaccard_join": jaccard.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
