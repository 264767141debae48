"""All queries of the library proper and their SQL."""

from __future__ import annotations

from notelake.plans import queries_rank, queries_text  # noqa: F401  (they register on import)
from notelake.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
