"""All queries of the engine by name, and the SQL that each is compared with."""

from __future__ import annotations

from credence.plans import further_queries, more_queries  # noqa: F401  (register their queries)
from credence.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
