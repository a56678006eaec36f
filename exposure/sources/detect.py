"""Which scanner wrote a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Root element -> scanner.
ROOTS = {"nmaprun": "nmap", "NessusClientData": "nessus", "NessusClientData_v2": "nessus"}
#: What may stand before the root element: a byte order mark, declarations, comments and a document type.
PROLOG = r"(?s)^\uFEFF?\s*(?:(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>)\s*)*+"


def scanner_of(root: Column) -> Column:
    out = None
    for name, scanner in ROOTS.items():
        out = F.when(root == name, scanner) if out is None else out.when(root == name, scanner)
    return out.otherwise("unknown")


def detect_format(document: Column) -> Column:
    """``nmap``, ``nessus`` or ``unknown`` from the first element, however long the prolog before it."""
    return scanner_of(F.regexp_extract(document, PROLOG + r"<([\w:.-]+)", 1))


def file_formats(spark: SparkSession, paths) -> DataFrame:
    """``scan_id`` (the path) and ``format`` of every file, ``unknown`` ones included.

    Files are read as text that ends at each ``>``, in splits, so no file is loaded whole. Each
    file's first piece that begins an element names the root. Comments are passed over: a
    piece inside one is known by the number of comments opened and closed before it, for which
    only the pieces up to the first element outside a comment that the file could have, the
    first whose own text is not part of a comment, are looked at.
    """
    pieces = spark.read.option("lineSep", ">").text(paths).select(
        F.col("_metadata.file_path").alias("scan_id"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), "value",
    )
    opens = F.col("value").contains("<!--")
    closes = F.col("value").endswith("--")
    name = F.regexp_extract("value", r"^\uFEFF?\s*<([A-Za-z_][\w:.-]*)", 1)
    # Scanners close their comments before the root; the last comment closed before the first marker bounds the prolog.
    marks = pieces.withColumn("name", name).where(opens | closes | (F.col("name") != ""))
    marks = marks.select("scan_id", "at", "name", F.when(opens, 1).otherwise(0).alias("opened"), F.when(closes, 1).otherwise(0).alias("closed"))
    known = marks.groupBy("scan_id").agg(F.min(F.when(F.col("name").isin(*ROOTS), F.col("at"))).alias("bound"), F.min(F.when(F.col("name") != "", F.col("at"))).alias("first"))
    prolog = marks.join(known, "scan_id").where(F.col("at") <= F.coalesce("bound", "first"))
    before = Window.partitionBy("scan_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.col("opened") - F.col("closed")).over(before), F.lit(0))
    roots = prolog.withColumn("depth", depth).where((F.col("name") != "") & (F.col("depth") <= 0)).groupBy("scan_id").agg(F.min_by("name", "at").alias("root"))
    files = pieces.select("scan_id").distinct()
    return files.join(roots, "scan_id", "left").select("scan_id", scanner_of(F.coalesce("root", F.lit(""))).alias("format"))


def rejects(formats: DataFrame) -> DataFrame:
    """Files no reader accepts."""
    return formats.where(F.col("format") == "unknown")
