"""Registered queries and the SQL each must agree with."""

from rankweave.queries import scalars, sequences, sets  # noqa: F401  (importing registers)
from rankweave.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
