"""All queries of the package but those of training-data preparation, and their SQL."""

from __future__ import annotations

from . import addition_queries, analysis_queries, catalog_queries, number_queries, package_queries, run_queries, sequence_queries, text_queries

MODULES = (catalog_queries, run_queries, text_queries, number_queries, sequence_queries, analysis_queries, package_queries, addition_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
