"""Field search over an inventory.

A search is a list of ``(field, value)`` terms, all of which must hold. Each term is
a predicate on the host or a left semi join with the matching ports, tags or CVEs, so
a whole search is one plan and nothing is collected.

Plain values match anywhere in the text; ``*`` matches any run of characters and then
the whole text must match. Case never matters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from exposure import dims
from exposure.functions import columns as C
from exposure.inventory import Inventory
from exposure.operators import filters
from exposure.operators.risk import score_hosts
from exposure.operators.tags import with_tags
from exposure.operators.vulns import hosts_matching

KEY = C.HOST_KEY
PORT_RANGE = re.compile(r"^(\d+)-(\d+)$")


def matches(col: Column, value: str) -> Column:
    """Substring test, or a whole-text test where ``value`` holds a ``*``."""
    value = value.lower()
    text = F.lower(col.cast("string"))
    if "*" not in value:
        return text.contains(value)
    escaped = re.sub(r"([\\%_])", r"\\\1", value).replace("*", "%")
    return text.like(escaped)


def _open(inv: Inventory) -> DataFrame:
    return inv.ports.where(F.col("state") == "open")


def by_port(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
    """Open ports; ``80-443`` is a range, other values match as text."""
    bounds = PORT_RANGE.match(value)
    if bounds:
        hit = F.col("port").between(int(bounds[1]), int(bounds[2]))
    else:
        hit = matches(F.col("port"), value)
    return filters.hosts_with(hosts, _open(inv).where(hit))


def by_service(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
    return filters.hosts_with(hosts, _open(inv).where(matches(F.col("svc"), value)))


def by_product(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
    """Any port state."""
    return filters.hosts_with(hosts, inv.ports.where(matches(F.col("product"), value)))


def host_field(name: str):
    def run(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
        return hosts.where(matches(F.col(name), value))

    return run


def by_tag(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
    hit = F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda label: matches(label, value))
    return with_tags(hosts, inv.tags).where(hit).select(*hosts.columns)


def by_owner(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
    return with_tags(hosts, inv.tags).where(matches(F.col("owner"), value)).select(*hosts.columns)


def by_cve(hosts: DataFrame, inv: Inventory, value: str, source: str = "both") -> DataFrame:
    """CVEs matched by CPE, reported by findings, or both.

    The database is filtered first and reduced to the products with such a CVE, which is all a host is tested for.
    """
    hits = []
    if source in ("both", "database") and inv.vuln_db is not None:
        hits.append(hosts_matching(inv.ports, inv.vuln_db.where(matches(F.col("cve"), value))))
    if source in ("both", "findings") and inv.findings is not None:
        hits.append(inv.findings.where(F.exists("cves", lambda c: matches(c, value))).select(*KEY))
    return filters.hosts_with(hosts, reduce(DataFrame.unionByName, hits)) if hits else hosts.where(F.lit(False))


def by_admin(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
    """``true``, ``yes`` or ``*`` for any administrative port, else its name or category."""
    dim = dims.admin_dim(inv.ports.sparkSession)
    if value.lower() not in ("true", "yes", "*"):
        dim = dim.where(matches(F.col("admin_name"), value) | matches(F.col("admin_category"), value))
    return filters.hosts_with(hosts, _open(inv).join(F.broadcast(dim.select("port")), "port", "left_semi"))


def by_risk(hosts: DataFrame, inv: Inventory, *values: str) -> DataFrame:
    """``>n``, ``<n``, or ``n`` for at least n; all of ``values`` on one score. Anything but a number matches no host."""
    risk, hit = F.col("risk"), F.lit(True)
    for value in values:
        number = value.lstrip("<>").strip()
        if not number.lstrip("+-").isdigit():
            return hosts.where("false")
        bound = int(number)
        hit = hit & (risk > bound if value.startswith(">") else risk < bound if value.startswith("<") else risk >= bound)
    return score_hosts(hosts, inv.ports, inv.findings).where(hit).select(*hosts.columns)


def search_text(hosts: DataFrame, inv: Inventory) -> DataFrame:
    """Hosts with ``search_text``: IP, host name, open ports with service and product, OS.

    Ports are distinct per host and number at most 65,536 per protocol, so the
    collected list is bounded. The lists of all hosts are far larger than the files
    of the ports, by whose size Spark would broadcast them, and are joined by sorting.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    ports = _open(inv).groupBy(*KEY).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("port", "proto", blank("svc").alias("s"), blank("product").alias("p")))),
                lambda x: F.concat_ws(" ", x["port"].cast("string"), x["s"], x["p"]),
            ), " ",
        ).alias("port_text")
    )
    joined = hosts.join(ports.hint("merge"), KEY, "left")
    text = F.lower(F.concat_ws(" ", F.col("ip"), blank("hostname"), blank("port_text"), blank("os_name")))
    return joined.select(*[F.col(c) for c in hosts.columns], text.alias("search_text"))


def by_text(hosts: DataFrame, inv: Inventory, value: str) -> DataFrame:
    return search_text(hosts, inv).where(matches(F.col("search_text"), value)).select(*hosts.columns)


FIELDS = {
    "port": by_port, "service": by_service, "svc": by_service, "product": by_product,
    "os": host_field("os_name"), "ip": host_field("ip"), "host": host_field("hostname"),
    "hostname": host_field("hostname"), "mac": host_field("mac"),
    "tag": by_tag, "label": by_tag, "owner": by_owner, "cve": by_cve, "admin": by_admin, "risk": by_risk, "text": by_text,
}


def search(inv: Inventory, terms: list[tuple[str, str]]) -> DataFrame:
    """Hosts meeting every term; no terms means all hosts, an unknown field means text.

    All risk terms are tested on one score, after the others have narrowed the hosts.
    """
    risks = [value for field, value in terms if field.lower() == "risk"]
    others = [(field.lower(), value) for field, value in terms if field.lower() != "risk"]
    hosts = reduce(lambda hosts, term: FIELDS.get(term[0], by_text)(hosts, inv, term[1]), others, inv.hosts)
    return by_risk(hosts, inv, *risks) if risks else hosts


def search_and_filter(inv: Inventory, terms: list[tuple[str, str]], filter_name: str = "all") -> DataFrame:
    """Up hosts meeting every term and the named entity filter."""
    return search(inv.with_tables(hosts=filters.entity_filter(inv, filter_name)), terms)


def visible_of(inv: Inventory, shown: DataFrame) -> DataFrame:
    """Per scan: up hosts in all, and how many of them are ``shown``."""
    visible = shown.groupBy("scan_id").agg(F.count(F.lit(1)).alias("visible"))
    total = filters.up_hosts(inv.hosts).groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"))
    return total.join(visible, "scan_id", "left").select("scan_id", F.coalesce("visible", F.lit(0).cast("bigint")).alias("visible"), "total")


def visibility(inv: Inventory, terms: list[tuple[str, str]], filter_name: str = "all") -> DataFrame:
    """Per scan: up hosts in all, and how many the search and filter leave visible."""
    return visible_of(inv, search_and_filter(inv, terms, filter_name))


def quick_search(inv: Inventory, value: str) -> DataFrame:
    """Hosts whose IP, host name, OS, or any port number or service contains ``value``."""
    ports = inv.ports.where(matches(F.col("port"), value) | matches(F.col("svc"), value)).groupBy(*KEY).agg(F.lit(True).alias("port_hit"))
    direct = [F.coalesce(matches(F.col(c), value), F.lit(False)) for c in ("ip", "hostname", "os_name")]
    hit = reduce(Column.__or__, direct) | F.coalesce("port_hit", F.lit(False))
    return inv.hosts.join(ports, KEY, "left").where(hit).select(*inv.hosts.columns)
