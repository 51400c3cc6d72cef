"""Every registered query with its oracle SQL."""

from __future__ import annotations

from sievework.catalog import clean, compare, evaluation, learn, values  # noqa: F401
from sievework.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
