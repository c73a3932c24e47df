"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, importance, jaccard_join, language_model, line_dedup, neighbours, pii, substring_dedup, toxicity, url_reputation, whitening

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_language_model": language_model.op2_language_model,
    "op3_bpe": bpe.op3_bpe,
    "op4_pii": pii.op4_pii,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_url_reputation": url_reputation.op8_url_reputation,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_importance": importance.op11_importance,
    "op12_chat": chat.op12_chat,
    "op13_whitening": whitening.op13_whitening,
}
SQL = {
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_url_reputation": url_reputation.OP8_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_importance": importance.OP11_SQL,
    "op12_chat": chat.OP12_SQL,
}
