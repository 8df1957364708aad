"""The queries of the engine's own operators, each with the equivalent SQL. Every query reads its whole tables."""

from __future__ import annotations

from quillmark.plans import assembly, curation, evidence_plans, parsing, reasoning_plans

_MODULES = [curation, evidence_plans, assembly, parsing, reasoning_plans]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
