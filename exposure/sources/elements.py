"""Splittable reading of large XML reports.

Text is split at the closing tag of the repeated element (``</host>``,
``</ReportHost>``), so one huge report is read by many tasks, each parsing
whole elements with the built-in XML function. A record's position in its file is kept
as ``host_ord`` for the rules that depend on document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

XML_OPTIONS = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}


def read_records(spark: SparkSession, paths, closing_tag: str) -> DataFrame:
    """``scan_id`` (the file path), ``host_ord`` and ``value``: text up to each closing tag."""
    return with_position(located(spark.read.option("lineSep", closing_tag).text(paths)))


def stream_records(spark: SparkSession, path: str, closing_tag: str, **options: str) -> DataFrame:
    """The records of a landing folder as a stream; each batch is then given positions."""
    return located(spark.readStream.option("lineSep", closing_tag).options(**options).text(path))


def located(raw: DataFrame) -> DataFrame:
    """Text rows with the file they came from and where their split starts."""
    return raw.select(F.col("_metadata.file_path").alias("scan_id"), F.col("_metadata.file_block_start").alias("block"), "value")


def with_position(records: DataFrame) -> DataFrame:
    """Adds ``host_ord``: splits order by where they start, rows by their number within the split."""
    place = F.struct("block", F.monotonically_increasing_id().alias("row"))
    return records.select("scan_id", place.alias("host_ord"), "value")


def element(value: Column, name: str) -> Column:
    """The text of the element that the closing tag ended, tags included."""
    return F.concat(F.regexp_extract(value, rf"(?s)(<{name}[\s>].*)$", 1), F.lit(f"</{name}>"))


def has_element(value: Column, name: str) -> Column:
    return value.rlike(rf"<{name}[\s>]")


def opening_tag(value: Column, name: str) -> Column:
    """An opening tag with its attributes, as an empty element; ``''`` where absent."""
    tag = F.regexp_extract(value, rf'<{name}(?:\s+[\w:.-]+="[^"]*")*\s*>', 0)
    return F.regexp_replace(tag, r"\s*>$", "/>")


def parse_xml(text: Column, schema: str) -> Column:
    return F.from_xml(text, schema, XML_OPTIONS)


def once(value: Column) -> Column:
    """``value`` as a generated column. Spark would otherwise put a plain one into each condition and column that reads it, and
    parse an element again for each of them."""
    return F.explode(F.array(value))


def parse_checked(text: Column, schema: str) -> Column:
    """As :func:`parse_xml`, with the text itself in ``_broken`` if it is not well formed."""
    return F.from_xml(text, f"{schema}, _broken string", {**XML_OPTIONS, "columnNameOfCorruptRecord": "_broken"})
