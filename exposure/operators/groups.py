"""Grouping up hosts by operating system, subnet, dominant service or risk level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from exposure import dims
from exposure.functions import columns as C

KEY = C.HOST_KEY


def dominant_service(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Hosts with ``service_group``: the group most of their open ports belong to.

    Earlier groups win ties; hosts matching none are ``other``. A count per group and
    host is at most six rows, packed so that ``max`` picks both count and order.
    """
    last = len(dims.SERVICE_GROUPS)
    groups = F.broadcast(dims.service_group_dim(ports.sparkSession))
    matches = (
        ports.where(F.col("state") == "open").join(groups, "port")
        .groupBy(*KEY, "group_order").agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*KEY).agg(F.max(F.col("n") * last + (last - 1 - F.col("group_order"))).alias("best"))
    )
    name = C.case_of(last - 1 - F.col("best") % last, {i: g for i, (g, _) in enumerate(dims.SERVICE_GROUPS)})
    return hosts.join(matches, KEY, "left").select(*[F.col(c) for c in hosts.columns], F.coalesce(name, F.lit("other")).alias("service_group"))


def group_hosts(hosts: DataFrame, key: Column, labels: dict | None = None) -> DataFrame:
    """Per scan and key: number of up hosts, with a display label."""
    counted = hosts.where(F.col("status") == "up").groupBy("scan_id", key.alias("group_key")).agg(F.count(F.lit(1)).alias("hosts"))
    label = F.coalesce(C.case_of(F.col("group_key"), labels), "group_key") if labels else F.col("group_key")
    return counted.withColumn("group_label", label)


def by_os(hosts: DataFrame, profile: str = "web") -> DataFrame:
    return group_hosts(hosts, C.os_class(F.col("os_name"), profile), dims.GROUP_LABELS["os"])


def by_subnet(hosts: DataFrame, mask: int = 24) -> DataFrame:
    """Groups by network address, with the size facts of the mask."""
    return group_hosts(hosts, C.subnet_key(F.col("ip"), mask)).select(
        "*", F.lit(mask).alias("mask"), F.lit(C.subnet_hosts(mask)).cast("bigint").alias("subnet_hosts"),
        F.lit(C.subnet_networks(mask)).alias("subnets_in_16"),
    )


def by_service(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    return group_hosts(dominant_service(hosts, ports), F.col("service_group"), dims.GROUP_LABELS["service"])


def by_risk(scored: DataFrame) -> DataFrame:
    return group_hosts(scored, C.risk_level(F.col("risk")), dims.GROUP_LABELS["risk"])


def largest_first(groups: DataFrame) -> DataFrame:
    """Groups in display order: most hosts first, then by key."""
    return groups.orderBy("scan_id", F.desc("hosts"), "group_key")


def os_distribution(hosts: DataFrame, profile: str = "web") -> DataFrame:
    """Per scan: hosts per operating-system class.

    Web counts up hosts under lower-case classes, desktop all hosts under capitalised ones.
    """
    if dims.check_profile(profile) == "web":
        hosts, label = hosts.where(F.col("status") == "up"), C.os_class(F.col("os_name"), profile)
    else:
        label = F.initcap(C.os_class(F.col("os_name"), profile))
    return hosts.groupBy("scan_id", label.alias("os_class")).agg(F.count(F.lit(1)).alias("hosts"))
