"""Queries by name over a folder of tables, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans.oracle import ORACLE
from .plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
