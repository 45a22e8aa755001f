"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from .catalogue import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
