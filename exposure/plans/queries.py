"""All registered queries."""

from exposure.plans import change_queries, fleet_queries, index_queries, order_queries, reject_queries, source_queries, split_queries, stream_queries, validity_queries  # noqa: F401
from exposure.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
