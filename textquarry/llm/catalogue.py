"""The queries opN_<name> and their SQL."""

from textquarry.llm import conversation_repair, embedding, filter_audit, html_wrappers, minhash, mixing, packing, pii, quality, quality_rules, secrets, sentencepiece_codec, toxicity

_MODULES = (quality, sentencepiece_codec, embedding, pii, secrets, toxicity, quality_rules, minhash, mixing, html_wrappers, filter_audit, conversation_repair, packing)

QUERIES = {m.QUERY: m.query for m in _MODULES}
ORACLES = {m.QUERY: m.ORACLE_SQL for m in _MODULES if m.ORACLE_SQL is not None}
