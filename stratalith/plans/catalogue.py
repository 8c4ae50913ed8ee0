"""All queries of the library outside the optional ``llm`` subpackage."""

from __future__ import annotations

from stratalith.plans import changesets, encoders, framework, incremental, retrieval, structure

_MODULES = (retrieval, structure, incremental, encoders, changesets, framework)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
