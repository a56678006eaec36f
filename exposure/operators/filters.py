"""Host and port filters. Each one returns a subset of its first argument, unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposure import dims
from exposure.functions import columns as C
from exposure.operators.risk import with_port_risk
from exposure.operators.tags import with_tags

KEY = C.HOST_KEY


def open_ports(ports: DataFrame) -> DataFrame:
    return ports.where(F.col("state") == "open")


def filtered_ports(ports: DataFrame) -> DataFrame:
    return ports.where(F.col("state") == "filtered")


def up_hosts(hosts: DataFrame) -> DataFrame:
    return hosts.where(F.col("status") == "up")


def hosts_with(hosts: DataFrame, children: DataFrame) -> DataFrame:
    """Hosts that have a row in ``children``: a left semi join on the host key."""
    return hosts.join(children.select(*KEY), KEY, "left_semi")


def admin_hosts(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Hosts with an open administrative port."""
    admin = F.broadcast(dims.admin_dim(ports.sparkSession).select("port"))
    return hosts_with(hosts, open_ports(ports).join(admin, "port", "left_semi"))


def cleartext_hosts(hosts: DataFrame, ports: DataFrame, profile: str = "web") -> DataFrame:
    """Hosts with an open port that speaks a cleartext protocol."""
    return hosts_with(hosts, with_port_risk(open_ports(ports), profile).where("is_cleartext"))


def high_risk_hosts(scored: DataFrame, at_least: int = 50) -> DataFrame:
    return scored.where(F.col("risk") >= at_least)


def _labels():
    return F.coalesce("labels", F.array().cast("array<string>"))


def key_terrain_hosts(hosts: DataFrame, tags: DataFrame) -> DataFrame:
    """Hosts tagged as key terrain."""
    wanted = F.array(*[F.lit(label) for label in dims.KEY_TERRAIN_LABELS])
    return with_tags(hosts, tags).where(F.arrays_overlap(_labels(), wanted)).select(*hosts.columns)


def tagged_hosts(hosts: DataFrame, tags: DataFrame) -> DataFrame:
    """Hosts with any label, an owner or a note."""
    has = (F.size(_labels()) > 0) | F.col("owner").isNotNull() | F.col("notes").isNotNull()
    return with_tags(hosts, tags).where(has).select(*hosts.columns)


def labelled_hosts(hosts: DataFrame, tags: DataFrame, label: str) -> DataFrame:
    return with_tags(hosts, tags).where(F.array_contains(_labels(), label)).select(*hosts.columns)


def production_hosts(hosts: DataFrame, tags: DataFrame) -> DataFrame:
    return labelled_hosts(hosts, tags, "production")


def findings_of_severity(rollup: DataFrame, severity: int) -> DataFrame:
    return rollup.where(F.col("severity") == severity)


def entity_filter(inventory, name: str, profile: str = "web") -> DataFrame:
    """Up hosts passing one named filter: all, up, ckt, tagged, admin, cleartext, risk, production."""
    from exposure.operators.risk import score_hosts

    hosts = up_hosts(inventory.hosts)
    if name in ("all", "up"):
        return hosts
    if name == "ckt":
        return key_terrain_hosts(hosts, inventory.tags)
    if name == "tagged":
        return tagged_hosts(hosts, inventory.tags)
    if name == "production":
        return production_hosts(hosts, inventory.tags)
    if name == "admin":
        return admin_hosts(hosts, inventory.ports)
    if name == "cleartext":
        return cleartext_hosts(hosts, inventory.ports, profile)
    if name == "risk":
        scored = score_hosts(hosts, inventory.ports, inventory.findings, profile)
        return high_risk_hosts(scored).select(*hosts.columns)
    raise ValueError(f"unknown filter {name!r}")
