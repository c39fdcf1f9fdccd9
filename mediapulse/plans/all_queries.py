"""Imports every module of queries, so that the registry is full."""

from . import (  # noqa: F401
    cluster_queries,
    gate_queries,
    report_queries,
    sink_queries,
    source_queries,
    stream_queries,
    text_queries,
    theme_queries,
    volume_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
