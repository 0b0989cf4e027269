"""The registry of the library's queries: name to function, and name to SQL."""

from __future__ import annotations

from . import assembly, catalogue, clauses, dossier, evaluation, evidence, files, findings, gate, judging, matching, merging, notices, pages, profile, reports, search, selection, streams, texts, vocabularies

FLAGSHIP = "j1_merge_orders"
_MODULES = (catalogue, texts, matching, selection, assembly, reports, vocabularies, clauses, judging, evidence, notices, pages, profile, findings, streams, files, pages, evaluation, gate, dossier, search, merging)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
