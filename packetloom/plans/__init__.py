"""Registered queries and end-to-end runs."""

from . import io_queries  # noqa: F401  (registers its queries beside the others)
from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
