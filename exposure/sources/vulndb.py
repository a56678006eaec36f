"""The vulnerability database: CPE -> CVE entries, and NVD pages it is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposure import schemas
from exposure.sources import objects


def _rows(df: DataFrame, cpe: Column, entries: Column) -> DataFrame:
    """One row per entry; a CPE with no entries keeps one row with a null CVE."""
    return df.select(cpe.alias("cpe"), F.posexplode_outer(entries).alias("ord", "v")).select(
        "cpe", F.col("ord").cast("bigint").alias("ord"), F.col("v.cve").alias("cve"), F.col("v.cvss").alias("cvss"),
        F.col("v.severity").alias("severity"), F.coalesce("v.desc", "v.description").alias("descr"),
    )


def parse_documents(docs: DataFrame, column: str) -> DataFrame:
    """Database rows from JSON objects ``{cpe: [{cve, cvss, desc}, ...]}``, one object per row.

    Both spellings of the fields are read: ``desc`` or ``description``, ``cvss`` or ``severity``.
    """
    entries = docs.select(F.explode(F.from_json(column, schemas.VULN_DB)).alias("cpe", "entries"))
    return _rows(entries, F.col("cpe"), F.col("entries"))


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """Files holding one JSON object each. A file is one task; :func:`read_split` reads large ones by many."""
    return parse_documents(spark.read.text(paths, wholetext=True), "value")


def read_split(spark: SparkSession, paths) -> DataFrame:
    """As :func:`read_documents`, with files of any size cut at the ends of entries."""
    return parse_documents(objects.read_entries(spark, paths, "]"), "value")


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """The splittable form: one entry per line, with its CPE and its place among the CPE's entries."""
    return spark.read.schema(schemas.VULN_DB_LINE).json(paths).withColumnRenamed("desc", "descr")


def cvss_score(metrics: Column) -> Column:
    """CVSS v3.1, else v3.0, else v2, of the first metric of each."""
    first = lambda name: F.get(metrics[name], F.lit(0))["cvssData"]["baseScore"]
    return F.coalesce(first("cvssMetricV31"), first("cvssMetricV30"), first("cvssMetricV2"))


def english_description(descriptions: Column, length: int = 200) -> Column:
    """The first English description, cut to ``length`` characters; ``''`` without one."""
    english = F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"]
    return F.coalesce(F.substring(english, 1, length), F.lit(""))


def parse_nvd(pages: DataFrame, column: str) -> DataFrame:
    """CVE structs from NVD API pages held as JSON text."""
    page = F.from_json(column, schemas.NVD_PAGE)
    return pages.select(F.explode(page["vulnerabilities"]).alias("v")).select("v.cve.*")


def read_nvd(spark: SparkSession, paths) -> DataFrame:
    """CVE structs from saved NVD API pages (at most 2,000 CVEs per file)."""
    pages = spark.read.schema(schemas.NVD_PAGE).option("multiLine", True).json(paths)
    return pages.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")


def published_since(cves: DataFrame, as_of, days: int) -> DataFrame:
    """CVEs published from ``days`` before ``as_of`` to the end of that day."""
    day = F.to_date(F.lit(as_of))
    return cves.where(F.to_date(F.substring("published", 1, 10)).between(F.date_sub(day, days), day))


def matching_cpe(cves: DataFrame, pattern: str) -> DataFrame:
    """CVEs with a matching configuration; ``*`` in the pattern matches any run of characters."""
    like = pattern.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_").replace("*", "%")
    hit = lambda m: m["criteria"].like(like)
    return cves.where(F.exists("configurations", lambda c: F.exists(c["nodes"], lambda n: F.exists(n["cpeMatch"], hit))))


def cpe_cves(cves: DataFrame) -> DataFrame:
    """Distinct (CPE, CVE) of vulnerable configurations with score and description.

    Duplicates can only come from one CVE, so they are removed inside its row and no
    shuffle is needed.
    """
    all_matches = F.flatten(F.flatten(F.transform("configurations", lambda c: F.transform(c["nodes"], lambda n: n["cpeMatch"]))))
    vulnerable = F.filter(all_matches, lambda m: m["vulnerable"] & (m["criteria"] != ""))
    criteria = F.array_distinct(F.transform(vulnerable, lambda m: m["criteria"]))
    return cves.select(
        F.explode(criteria).alias("cpe"), F.col("id").alias("cve"), cvss_score(F.col("metrics")).alias("cvss"),
        english_description(F.col("descriptions")).alias("descr"),
    )


def database_from_nvd(cves: DataFrame) -> DataFrame:
    """NVD CVEs as database rows; entries of a CPE are ordered by CVE id.

    ``ord`` is the id's year and number in one integer.
    """
    year, number = (F.regexp_extract("cve", r"^CVE-(\d{4})-(\d+)$", k).try_cast("bigint") for k in (1, 2))
    return cpe_cves(cves).select(
        "cpe", F.coalesce(year * 10_000_000_000 + number, F.lit(0).cast("bigint")).alias("ord"), "cve", "cvss", F.lit(None).cast("string").alias("severity"), "descr"
    )
