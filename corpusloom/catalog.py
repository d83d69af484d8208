"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from corpusloom.plans import coverage, facts, packing, questions, scalars, sinks, sources, streams, subjects  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
