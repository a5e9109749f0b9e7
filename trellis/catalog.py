"""All registered queries and their SQL."""

from __future__ import annotations

from .plans import bank, drawn, evaluation, graph, prompting, questions, results  # noqa: F401
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
