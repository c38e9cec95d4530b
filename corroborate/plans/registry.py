"""The registered queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from corroborate.plans import control_queries, eval_queries, evidence_queries, extension_queries, index_queries, research_queries, source_queries, text_queries

_MODULES = (text_queries, evidence_queries, eval_queries, research_queries, extension_queries, control_queries, source_queries, index_queries)

QUERIES: dict = {}
ORACLES: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES

FLAGSHIP = QUERIES["keyword_topk"]
