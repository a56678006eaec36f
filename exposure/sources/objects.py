"""Splittable reading of large JSON objects ``{key: value, ...}``.

A JSON reader takes a whole object in one task. Here text is split at every ``]`` or ``}``, so that one huge object is read
by many tasks, and an entry ends at a closing sign outside strings that leaves only the object itself open. Whether a sign
lies in a string and how deep it lies depends on all the text before it. Each file split is summed up for both cases, that
it begins inside a string or outside; the sums of a file's splits, one row a split, are carried over the split borders.

A closing sign is never escaped in JSON, so no escape is cut in two. A file may hold several objects one after another.
Entries that repeat a key are kept, as are those before the end of a broken file. Empty files and objects give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from exposure.sources.elements import located, with_position

SPLIT = ["scan_id", "block"]
_EARLIER = (Window.unboundedPreceding, -1)


def _before(value: Column, window) -> Column:
    return F.coalesce(F.sum(value).over(window.rowsBetween(*_EARLIER)), F.lit(0).cast("bigint"))


def _depth(bare: Column, inside: Column, closing: str) -> Column:
    """How much deeper the text is after a piece and its closing sign, if the piece begins inside a string or not.

    ``bare`` is the piece without escapes.
    """
    text = F.concat(F.when(inside, '"').otherwise(""), bare, F.lit(closing))
    signs = F.regexp_replace(text, r'"[^"]*("|$)', "")
    return (F.length(F.regexp_replace(signs, r"[^{\[]", "")) - F.length(F.regexp_replace(signs, r"[^}\]]", ""))).cast("bigint")


def _with_depth(pieces: DataFrame, closing: str) -> DataFrame:
    """Adds ``inside`` (the piece ends in a string) and ``depth`` (how many signs are open after its closing sign)."""
    within = Window.partitionBy(*SPLIT).orderBy("row")
    bare = F.regexp_replace("value", r"\\.", "")
    marked = pieces.withColumn("bare", bare).withColumn("quotes", F.length(F.regexp_replace("bare", '[^"]', "")).cast("bigint"))
    marked = marked.withColumn("odd", _before(F.col("quotes"), within) % 2 == 1)
    both = marked.withColumn("outer", _depth(F.col("bare"), F.col("odd"), closing)).withColumn("inner", _depth(F.col("bare"), ~F.col("odd"), closing))
    splits = both.groupBy(*SPLIT).agg(*[F.sum(c).alias(c) for c in ("quotes", "outer", "inner")])
    in_file = Window.partitionBy("scan_id").orderBy("block")
    splits = splits.withColumn("begins_inside", _before(F.col("quotes"), in_file) % 2 == 1)
    splits = splits.withColumn("begins_at", _before(F.when(F.col("begins_inside"), F.col("inner")).otherwise(F.col("outer")), in_file))
    here = both.withColumn("deeper_outer", F.sum("outer").over(within)).withColumn("deeper_inner", F.sum("inner").over(within))
    return here.join(splits.select(*SPLIT, "begins_inside", "begins_at"), SPLIT).select(
        *SPLIT, "row", "value",
        (F.col("begins_inside") != ((F.col("quotes") % 2 == 1) != F.col("odd"))).alias("inside"),
        (F.col("begins_at") + F.when(F.col("begins_inside"), F.col("deeper_inner")).otherwise(F.col("deeper_outer"))).alias("depth"),
    )


def read_entries(spark: SparkSession, paths, closing: str) -> DataFrame:
    """``scan_id`` (the file path) and ``value``: JSON objects of one or a few entries of the files' objects.

    ``closing`` is the sign that ends a value: ``]`` for lists, ``}`` for records. Entries whose value ends otherwise stay
    with the next one.
    """
    if closing not in ("]", "}"):
        raise ValueError("closing must be ] or }")
    pieces = with_position(located(spark.read.option("lineSep", closing).text(paths))).select("scan_id", "host_ord.block", "host_ord.row", "value")
    deep = _with_depth(pieces, closing)
    ends = ~F.col("inside") & (F.col("depth") <= 1)
    within = Window.partitionBy(*SPLIT).orderBy("row")
    cut = deep.withColumn("ends", ends).withColumn("entry", _before(F.col("ends").cast("bigint"), within))
    # An entry that begins in an earlier split belongs to the last split before it that holds an end.
    has_end = cut.groupBy(*SPLIT).agg(F.sum(F.col("ends").cast("bigint")).alias("n_ends"))
    in_file = Window.partitionBy("scan_id").orderBy("block").rowsBetween(*_EARLIER)
    last = F.last(F.when(F.col("n_ends") > 0, F.struct(F.col("block").alias("b"), F.col("n_ends").alias("n"))), ignorenulls=True).over(in_file)
    carried = has_end.select(*SPLIT, last.alias("last"))
    own = F.struct(F.col("block").alias("b"), F.col("entry").alias("n"))
    named = cut.join(carried, SPLIT).withColumn("entry", F.when(F.col("entry") > 0, own).otherwise(F.col("last")))
    piece = F.struct("block", "row", F.when(F.col("ends") & (F.col("depth") == 0) & F.lit(closing == "}"), F.col("value")).otherwise(F.concat("value", F.lit(closing))).alias("text"))
    whole = named.groupBy("scan_id", "entry").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    body = F.regexp_replace(F.array_join(F.col("pieces.text"), ""), r"^[\s\x{FEFF}{},]+", "")
    return whole.select("scan_id", body.alias("body")).where(F.col("body").startswith('"')).select(
        "scan_id", F.concat(F.lit("{"), "body", F.lit("}")).alias("value")
    )
