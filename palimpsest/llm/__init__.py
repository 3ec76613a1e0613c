"""Operators of a training-data pipeline over document corpora."""

from .queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
