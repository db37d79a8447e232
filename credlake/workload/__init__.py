"""Registered queries over the driver tables, each with its SQL counterpart."""
from credlake.workload import evidence_queries, model_queries, page_queries, text_queries  # noqa: F401
from credlake.workload.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
