"""All core queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("intervals", "scoring", "dyads", "series", "flagship", "validation", "clocks", "moments", "casework", "rules", "studies")


def gather() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = import_module(f"turnloom.plans.{name}")
        queries.update(module.QUERIES)
        sql.update(module.SQL)
    return queries, sql
