"""The registered queries and their SQL."""

from __future__ import annotations

from tilewright.plans import file_queries, text_queries  # noqa: F401  both register their queries
from tilewright.plans.core_queries import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
