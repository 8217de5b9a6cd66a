"""All registered queries."""

from . import (  # noqa: F401  (importing registers the queries)
    activity_queries,
    ingest_queries,
    invocation_queries,
    prompt_queries,
    reconcile_queries,
    stream_queries,
    tagged_queries,
)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
