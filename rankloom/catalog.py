"""All queries of the library and SQL that gives the same rows."""

from __future__ import annotations

from rankloom.queries import building, checking, modelling, retrieval, runs, selection, stores

_MODULES = (retrieval, selection, building, checking, modelling, stores, runs)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
