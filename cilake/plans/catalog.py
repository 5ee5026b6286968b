"""All registered queries."""

from cilake.plans import queries_docs, queries_logs, queries_state, queries_values  # noqa: F401
from cilake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
