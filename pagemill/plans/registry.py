"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pagemill.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
