"""The subpackage's registered queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from quillstack.llm import bpe, decontaminate, langid, lines, minhash, oracles, pii, substring, topk, toxicity, warc

QUERIES = {
    "op1_language_id": langid.query,
    "op2_bpe": bpe.query,
    "op3_topk": topk.query,
    "op4_minhash": minhash.query,
    "op5_pii": pii.query,
    "op6_line_dedup": lines.query,
    "op7_decontamination": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_substring_dedup": substring.query,
    "op10_warc": warc.query,
}

ORACLES: dict[str, str] = {
    "op3_topk": oracles.TOPK,
    "op4_minhash": oracles.MINHASH,
    "op9_substring_dedup": oracles.SUBSTRING,
    "op10_warc": oracles.WARC,
}
