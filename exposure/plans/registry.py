"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from exposure.plans.oracle_views import with_views
from exposure.plans.projection import Projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers ``f(projection)`` under its name; ``sql`` may name any oracle view."""

    def register(f):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Projection(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return register
