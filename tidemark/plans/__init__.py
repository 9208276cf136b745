"""Fixture tables and the queries under the inventory's IDs."""

from . import domain, landed, relational, textual
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "domain", "landed", "relational", "textual"]
