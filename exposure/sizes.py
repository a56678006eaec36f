"""Broadcasting behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a few short columns that may be sent to every executor.
BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows
