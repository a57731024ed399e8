"""All registered queries of the library, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from shutterlake.plans import core, kept, lookups, mutations, scalars  # noqa: F401
from shutterlake.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
