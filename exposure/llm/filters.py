"""Decisions about documents taken back to their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.shared import small, stored

ROW = "_row"


def without(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` but those of ids that ``decisions`` (doc_id, kept boolean) keeps in no row.

    Rows that share an id, null being one, are judged together: they stay if any of them is kept. The ids that go are the
    smaller side; they are sent to all tasks while they are few and joined by a shuffle beyond that."""
    gone = decisions.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select(F.col("doc_id").alias("_gone"))
    gone = small(stored(gone, "gone"), 1_000_000)
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]), "left_anti")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of those alike in id and text, the others as they are. Only ids that occur twice or more are looked at."""
    again = docs.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again")
    again = stored(again, "again")
    if not again.limit(1).count():
        return docs
    again = small(again)
    same = docs[id_col].eqNullSafe(again["_again"])
    return docs.join(again, same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and ``_row``, by which a row is known: its id and two hashes of its text. Only rows alike in both share one."""
    text, null = F.col(text_col), F.col(text_col).isNull()
    return docs.withColumn(ROW, F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text, null, F.col(id_col)).alias("a"), F.xxhash64(F.lit(1), text, null).alias("b")))


def without_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with ``_row``) but those that ``decisions`` (_row, kept boolean) doesn't keep, without ``_row``.

    Each row stands by its own text, whatever other rows have its id or no id either."""
    gone = decisions.groupBy(ROW).agg(F.max("kept").alias("kept")).where("not kept")
    gone = small(stored(gone.select(*(F.col(ROW)[k].alias(f"_gone_{k}") for k in ("id", "a", "b"))), "gone"), 1_000_000)
    own = docs[ROW]
    return docs.join(gone, own["id"].eqNullSafe(gone["_gone_id"]) & (own["a"] == gone["_gone_a"]) & (own["b"] == gone["_gone_b"]), "left_anti").drop(ROW)


def first_of_groups(groups: DataFrame) -> DataFrame:
    """(_row, kept) from the near-duplicate groups (_row, n_shingles, component_id): kept is the row of the smallest id of its
    group, null being the largest, and of the smallest hashes among those. Rows without shingles are no group and stay."""
    place = F.struct(F.col(ROW)["id"].isNull().alias("no_id"), F.col(ROW)["id"].alias("id"), F.col(ROW)["a"].alias("a"), F.col(ROW)["b"].alias("b"))
    placed = groups.where("n_shingles > 0").select(ROW, "component_id", place.alias("place"))
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    judged = placed.join(first, "component_id").select(ROW, F.col("place").eqNullSafe(F.col("first")).alias("kept"))
    return judged.union(groups.where("n_shingles = 0").select(ROW, F.lit(True)))
