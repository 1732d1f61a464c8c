"""Registered queries of the library (without the llm subpackage) and their SQL."""

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
