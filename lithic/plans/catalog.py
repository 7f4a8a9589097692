"""All registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from . import contracts, evaluation, geometry, records, rows, splitting

MODULES = (geometry, splitting, evaluation, records, contracts, rows)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
FLAGSHIP = "relation_counts"
