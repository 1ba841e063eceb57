"""Registered queries."""

from tracewell.workloads import audit_queries, classify_queries, ingest_queries, report_queries, sequence_queries, step_queries, text_queries  # noqa: F401
from tracewell.workloads.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
