"""Registered queries and their SQL."""

from foliant.plans import faults, kept
from foliant.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "faults", "kept"]
