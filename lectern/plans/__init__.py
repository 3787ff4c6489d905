"""Registered queries."""

from . import job_queries, stream_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "job_queries", "stream_queries", "text_queries"]
