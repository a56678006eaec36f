"""Session settings the operators are written for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "exposure", master: str | None = None, **extra: str) -> SparkSession:
    """A session with time zone UTC, adaptive execution and skew-join splitting on.

    Leave ``master`` unset on a cluster; ``spark-submit`` sets it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it a query's shuffle files go when the query ends, and not when the driver happens to collect its garbage: a job of
    many queries then takes the disk of its largest one."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``."""
    return spark.conf.get("spark.checkpoint.dir", None)
