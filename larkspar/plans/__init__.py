"""Registered queries of the relational library, each with its equivalent SQL where SQL has one."""

from larkspar.plans import aggregates, core, postgres, scalars, shapes  # noqa: F401
from larkspar.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
