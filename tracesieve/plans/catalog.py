"""All registered queries."""

from tracesieve.plans import (
    finding_queries,
    publish_queries,
    redaction_queries,
    session_queries,
    storage_queries,
    trajectory_queries,
)
from tracesieve.plans.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "finding_queries",
    "publish_queries",
    "redaction_queries",
    "session_queries",
    "storage_queries",
    "trajectory_queries",
]
