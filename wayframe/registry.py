"""All queries of the library by name, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from .plans import queries_network, queries_sources, queries_stream  # noqa: F401  (they register their queries)
from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
