"""Script results and fingerprints across the fleet."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposure.functions import columns as C, scripts as S

KEY = C.HOST_KEY


def all_scripts(port_scripts: DataFrame, host_scripts: DataFrame) -> DataFrame:
    """Port-level and host-level script results in one table; ``port`` is null at host level."""
    host_level = host_scripts.withColumn("port", F.lit(None).cast("int"))
    columns = [*KEY, "port", "script_id", "output"]
    return port_scripts.select(*columns).unionByName(host_level.select(*columns))


def vulnerability_scripts(scripts: DataFrame) -> DataFrame:
    return scripts.where(S.is_vulnerability(F.col("script_id")))


def script_findings(scripts: DataFrame) -> DataFrame:
    """Parsed results of the known scripts; vulnerability scripts are reported separately.

    One row per result with the union of all parser fields, and ``detail``, the line shown
    for it: the first of title, subject, OS, server, version, key algorithms,
    anonymous login, else the script id.
    """
    sid, out = F.col("script_id"), F.col("output")
    known = scripts.where(~S.is_vulnerability(sid) & sid.isin(*S.PARSERS))
    anonymous = F.when(sid == "ftp-anon", S.is_anonymous(out))
    keys = F.when(sid == "ssh-hostkey", S.ssh_keys(out))
    parsed = known.select(
        *KEY, "port", "script_id", S.finding_type(sid).alias("type"),
        *[S.field(name, sid, out).alias(name) for name in S.FIELDS],
        keys.alias("keys"), anonymous.alias("anonymous"),
        F.when(anonymous, "high").when(~anonymous, "info").alias("severity"),
    )
    shown = lambda name: C.blank_to_null(F.col(name))
    algorithms = C.blank_to_null(F.array_join(F.transform("keys", lambda k: k["algo"]), ", "))
    detail = F.coalesce(
        shown("title"), shown("subject"), shown("os"), shown("server"), shown("version"), algorithms,
        F.when(F.col("anonymous"), "Anonymous FTP!"), F.col("script_id"),
    )
    return parsed.withColumn("detail", detail)


def findings_rollup(findings: DataFrame) -> DataFrame:
    """Per finding type and detail line: results and hosts."""
    per_host = findings.groupBy("type", "detail", "ip").agg(F.count(F.lit(1)).alias("n"))
    return per_host.groupBy("type", "detail").agg(F.sum("n").alias("results"), F.count(F.lit(1)).alias("hosts"))


def certificate_expiry(findings: DataFrame, as_of) -> DataFrame:
    """Certificates with the days left at ``as_of`` (a date column or ISO text)."""
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    expires = F.to_date("expires")
    return findings.where((F.col("type") == "cert") & expires.isNotNull()).select(
        *KEY, "port", "subject", "issuer", expires.alias("expires"), F.datediff(expires, day).alias("days_left")
    )


def os_fingerprint_fields(hosts: DataFrame) -> DataFrame:
    """One row per host, section and key of the OS fingerprint; the last of repeated keys wins."""
    sections = hosts.where(F.col("os_fingerprint").isNotNull()).select(
        *KEY, F.posexplode(S.fingerprint_sections(F.col("os_fingerprint"))).alias("pos", "s")
    )
    pairs = sections.select(
        *KEY, F.col("s.0").alias("section"), "pos", F.posexplode(F.split(F.col("s.1"), "%")).alias("item", "pair")
    )
    parts = F.split("pair", "=")
    rows = pairs.where(F.size(parts) > 1).select(
        *KEY, "section", F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("value"), F.struct("pos", "item").alias("at")
    )
    return rows.where(F.col("key") != "").groupBy(*KEY, "section", "key").agg(F.max_by("value", "at").alias("value"))


def fingerprint_groups(fields: DataFrame) -> DataFrame:
    """How many hosts share each fingerprint value."""
    return fields.groupBy("section", "key", "value").agg(F.count(F.lit(1)).alias("hosts"))


def service_fingerprints(ports: DataFrame, column: str = "fp") -> DataFrame:
    """The response text of every service fingerprint."""
    return ports.where(F.col(column).isNotNull()).select(*KEY, "port", S.service_response(F.col(column)).alias("response")).where(
        F.col("response").isNotNull()
    )
