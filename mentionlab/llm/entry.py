"""Queries and oracle SQL of this subpackage, for the query registry."""

from __future__ import annotations

from mentionlab.llm import chat, classifier, decontaminate, langid, mixing, negatives, ppm, quality, repair, secrets, simhash, substrings, tokens


def queries() -> dict:
    return {"op1_secrets": secrets.op1_secrets, "op2_ppm": ppm.op2_ppm, "op3_chat": chat.op3_chat, "op4_simhash": simhash.op4_simhash, "op5_langid": langid.op5_langid, "op6_tokens": tokens.op6_tokens, "op7_decontaminate": decontaminate.op7_decontaminate, "op8_quality": quality.op8_quality, "op9_classifier": classifier.op9_classifier, "op10_mixing": mixing.op10_mixing, "op11_repair": repair.op11_repair, "op12_negatives": negatives.op12_negatives, "op13_substrings": substrings.op13_substrings}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.OP3_SQL, "op7_decontaminate": decontaminate.OP7_SQL, "op10_mixing": mixing.OP10_SQL, "op11_repair": repair.OP11_SQL, "op12_negatives": negatives.OP12_SQL, "op13_substrings": substrings.OP13_SQL}
