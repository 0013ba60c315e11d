"""The engine's registered queries and their oracle SQL."""

from __future__ import annotations

from gridloom.plans import errors, files, joins, products, solvers, stacks, surfaces, trends, values, warps  # noqa: F401  registers its queries
from gridloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
