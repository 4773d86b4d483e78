"""The queries of this folder, and their SQL twins where SQL can express them."""

from __future__ import annotations

from contactloom.llm import chat, collocations, dac, decontaminate, exact_topk, fill_middle, jaccard, lang_id, packing, quality, secret_scan, toxicity, warc

_MODULES = [quality, decontaminate, chat, jaccard, warc, dac, toxicity, exact_topk, packing, secret_scan, fill_middle, lang_id, collocations]


def queries() -> dict:
    return {m.QUERY: m.query for m in _MODULES}


def oracle_sql() -> dict:
    return {m.QUERY: m.ORACLE for m in _MODULES if getattr(m, "ORACLE", None)}
