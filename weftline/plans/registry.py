"""All queries over the standard tables, and the SQL that each must agree with."""

from __future__ import annotations

from weftline.plans import class_queries, join_queries, link_queries, operator_queries, series_queries, text_queries
from weftline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "class_queries", "join_queries", "link_queries", "operator_queries", "series_queries", "text_queries"]
