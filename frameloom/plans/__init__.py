"""Queries over the fixture tables, each with SQL that gives the same rows."""

from . import io_queries, relational_queries, segment_queries, stats_queries, vector_queries  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
