"""Operators of a training-data pipeline; nothing else in the package imports them."""

from panelwright.llm import queries
from panelwright.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "queries"]
