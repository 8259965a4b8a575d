"""Registered queries: each survey item as a Spark query over the driver tables, with its SQL."""

from ionloom.queries.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
