"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from stacksift.plans import queries_agg, queries_core, queries_files, queries_jobs, queries_stream, queries_text
from stacksift.plans.views import with_views

MODULES = (queries_core, queries_agg, queries_text, queries_files, queries_stream, queries_jobs)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for m in MODULES for name, sql in m.ORACLE.items()}
