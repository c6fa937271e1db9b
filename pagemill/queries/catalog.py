"""All queries of the library proper, by name, with their DuckDB oracles."""

from __future__ import annotations

from pagemill.queries import jobs, pages, stream, texts, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (urls, texts, pages, jobs, stream):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
