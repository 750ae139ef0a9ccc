"""All queries of the engine, by name, and their SQL."""

from __future__ import annotations

from . import chunks, collections, constitutions, ingest, library, media, retrieval, service, statutes, text

QUERIES, ORACLE_SQL = {}, {}
for module in (retrieval, text, chunks, collections, statutes, media, ingest, constitutions, library, service):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
