"""All registered queries."""

from emberline.plans import queries_metrics, queries_motion, queries_rows, queries_stream, queries_temporal  # noqa: F401
from emberline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
