"""Labelled rows for training: which are held out, and a bounded sample of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null for a null id)."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3).cast("int")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: those of fold 1. An id that is null has no label and isn't held out."""
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def training_labels(labels: DataFrame, names: list[str], id_col: str = "doc_id") -> DataFrame:
    """One row per doc_id that isn't held out: doc_id and the label columns, the largest value where rows disagree; rows
    with a null among them are left out."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(n).cast("double").alias(n) for n in names)).dropna()
    return own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, those with the smallest hash of doc_id: a sample that doesn't depend on the cluster."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
