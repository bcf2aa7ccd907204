"""The registered queries."""

from __future__ import annotations

from . import guide_queries, literal_queries, rank_queries, record_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
