"""Exports: host CSV in both layouts, nested JSON, CPE list, tags, vulnerability database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from exposure.functions import columns as C
from exposure.operators.tags import export_tags, with_tags

KEY = C.HOST_KEY


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def host_sheet(scored: DataFrame, ports: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Nine columns for up hosts: open ports joined by ``;``, risk and annotation.

    A host has at most 65,536 ports per protocol, which bounds the joined list.
    """
    opened = ports.where(F.col("state") == "open").groupBy(*KEY).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("port", "proto"))), lambda p: p["port"].cast("string")), ";").alias("port_list")
    )
    up = scored.where(F.col("status") == "up")
    if tags is not None:
        up = with_tags(up, tags)
    else:
        up = up.select("*", F.array().cast("array<string>").alias("labels"), F.lit("").alias("owner"), F.lit("").alias("notes"))
    return up.join(opened, KEY, "left").select(
        "scan_id", F.col("ip").alias("IP"), _blank("hostname").alias("Hostname"), _blank("mac").alias("MAC"), _blank("os_name").alias("OS"),
        _blank("port_list").alias("Open Ports"), F.col("risk").alias("Risk"),
        F.coalesce(F.array_join("labels", ";"), F.lit("")).alias("Labels"), _blank("owner").alias("Owner"), _blank("notes").alias("Notes"),
    )


def host_sheet_compact(scored: DataFrame) -> DataFrame:
    """Seven columns for all hosts: counts instead of lists."""
    return scored.select(
        "scan_id", F.col("ip").alias("IP"), _blank("hostname").alias("Hostname"), F.col("status").alias("Status"), _blank("os_name").alias("OS"),
        F.col("open_ports").alias("OpenPorts"), F.col("risk").alias("RiskScore"), F.col("cleartext_ports").alias("CleartextCount"),
    )


def write_csv(sheet: DataFrame, path: str, quote_all: bool = False, mode: str = "error") -> None:
    """CSV with a header and doubled quotes; one file per partition."""
    writer = sheet.drop("scan_id").write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "")
    writer.option("quoteAll", quote_all).csv(path)


def host_documents(inventory) -> DataFrame:
    """Hosts with their ports and trace nested, as in the JSON export.

    Ports and hops of a host are bounded by their number ranges. Findings are not, so they
    are documents of their own, whatever their number: :func:`finding_documents`.
    """
    fields = lambda df: F.struct(*[F.col(c) for c in df.columns if c not in KEY and c != "host_ord"])
    nest = lambda df, order, name: df.groupBy(*KEY).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), fields(df).alias("v")))), lambda x: x["v"]).alias(name)
    )
    docs = inventory.hosts.join(nest(inventory.ports, ["port", "proto"], "ports"), KEY, "left")
    if inventory.trace is not None:
        docs = docs.join(nest(inventory.trace, ["hop_ord"], "trace"), KEY, "left")
    return docs.withColumn("kind", F.lit("host"))


def finding_documents(inventory) -> DataFrame:
    """One document per finding, with the host's key and its place in the report."""
    return inventory.findings.withColumn("kind", F.lit("finding"))


def export_documents(inventory) -> DataFrame:
    """The documents of the JSON export as one column of text, one line each."""
    text = lambda df: df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    docs = text(host_documents(inventory))
    return docs if inventory.findings is None else docs.unionByName(text(finding_documents(inventory)))


def write_json(inventory, path: str, mode: str = "error") -> None:
    """One JSON document per line; ``kind`` says whether it is a host or a finding."""
    export_documents(inventory).write.mode(mode).text(path)


def cpe_list(ports: DataFrame) -> DataFrame:
    """Distinct port CPEs."""
    return ports.where(F.col("cpe").isNotNull()).select("cpe").distinct()


def tag_sheet(tags: DataFrame, hosts: DataFrame) -> DataFrame:
    """Tag records with current host details."""
    return export_tags(tags, hosts)


def vuln_documents(vuln_db: DataFrame) -> DataFrame:
    """Database rows in the line form the reader takes: one line per CPE and entry, with its place."""
    return vuln_db.where(F.col("cve").isNotNull()).select("cpe", "ord", "cve", "cvss", "severity", F.col("descr").alias("desc"))


def write_vuln_db(vuln_db: DataFrame, path: str, mode: str = "error") -> None:
    vuln_documents(vuln_db).write.mode(mode).json(path)
