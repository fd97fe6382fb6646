"""Queries over the given tables. Importing this package fills the registry."""

from spendlens.plans import detection, documents, live, monitoring, portfolio, quality, spending  # noqa: F401
from spendlens.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
