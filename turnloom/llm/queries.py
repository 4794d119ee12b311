"""The pN_ queries over text corpora, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_pii", "q_conversations", "q_splits", "q_documents", "q_turns", "q_language", "q_mixing")

_modules = [import_module(f"turnloom.llm.{name}") for name in MODULES]
QUERIES: dict = {k: v for m in _modules for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    """The twins; some are written out from tables that take a second to build, so only when asked for."""
    return {k: v for m in _modules for k, v in (m.sql() if hasattr(m, "sql") else m.SQL).items()}
