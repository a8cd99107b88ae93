"""All registered queries."""

from tagweave.plans import (context_queries, decision_queries, scalar_queries, scan_queries, stream_queries,  # noqa: F401
                            text_queries)
from tagweave.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
