"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from copse.llm import bpe, chat, exact_dedup, html, langid, packing, pii, quality, simhash, urlfilter

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_langid": langid.op3_langid,
    "op4_urls": urlfilter.op4_urls,
    "op5_pii": pii.op5_pii,
    "op6_html": html.op6_html,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_chat": chat.op9_chat,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_urls": urlfilter.ORACLE,
    "op7_quality": quality.ORACLE,
    "op9_chat": chat.ORACLE,
}
