"""All queries by name, and their SQL."""

from . import checking, judging, reports, retrieval, rows_only, searching, texts, tracing  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
