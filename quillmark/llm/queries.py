"""The queries and SQL of this subpackage."""

from quillmark.llm import formatting, leakage, matching, mixing, sampling, sentences, splitting

_MODULES = [splitting, matching, formatting, sampling, leakage, mixing, sentences]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
