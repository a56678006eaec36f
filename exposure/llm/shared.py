"""Tables that a job writes between its steps, in the folder that all executors share.

Each step that is read more than once, or whose lineage is long, is written as Parquet below ``spark.checkpoint.dir``;
a lost executor then costs tasks, not the steps before. Without that setting a local session uses a temporary folder and
any other session is refused, since executors don't see each other's disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder of the session."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="llm-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that may be sent to every executor.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcasting if it has at most ``rows`` rows; otherwise left to a shuffled join. ``df`` should
    be a stored table, as its rows are counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
