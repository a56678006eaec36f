"""Analyst tags from JSON: ``{asset key: {labels, owner, notes, lastIp, lastSeen}}``.

An older form maps a bare IP to a list of labels; both may sit in one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposure import schemas
from exposure.functions import columns as C
from exposure.sources import objects


def parse_documents(docs: DataFrame, column: str) -> DataFrame:
    """Tag rows from JSON objects, one object per row."""
    entries = docs.select(F.explode(F.from_json(column, "map<string,string>")).alias("asset_key", "body"))
    old = F.trim("body").startswith("[")
    record = F.from_json(F.when(~old, F.col("body")), schemas.TAG_RECORD)
    labels = F.when(old, F.from_json("body", "array<string>")).otherwise(record["labels"])
    return entries.select(
        "asset_key", F.coalesce(labels, F.array().cast("array<string>")).alias("labels"),
        C.blank_to_null(record["owner"]).alias("owner"), C.blank_to_null(record["notes"]).alias("notes"),
        C.blank_to_null(record["lastIp"]).alias("last_ip"), record["lastSeen"].try_cast("timestamp").alias("last_seen"),
    )


def read_documents(spark: SparkSession, paths) -> DataFrame:
    return parse_documents(spark.read.text(paths, wholetext=True), "value")


def read_split(spark: SparkSession, paths) -> DataFrame:
    """As :func:`read_documents`, with files of any size cut at the ends of records."""
    return parse_documents(objects.read_entries(spark, paths, "}"), "value")
