"""All registered queries over the supplied tables and their SQL twins."""

from __future__ import annotations

from tessera.plans import counting, filtering, fitting, joining, sampling, scoring  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
