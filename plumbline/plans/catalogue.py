"""All registered queries."""

from __future__ import annotations

from plumbline.plans import changes, labels, pieces, quality, search  # noqa: F401  they register their queries
from plumbline.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
