"""Inverted postings: which hosts carry a port, service, product, OS word, tag or CVE.

The postings are a long table with one row per kind, key and IP. The key of a popular
term (port 443) is on a large part of all rows, so the list per key is never
built; counts per key pre-aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from exposure.functions import columns as C
from exposure.inventory import Inventory
from exposure.operators.tags import with_tags
from exposure.operators.vulns import class_products, cve_classes, match_cves, open_products

KEY = C.HOST_KEY


def _host_keys(rows: DataFrame, **kinds: Column) -> DataFrame:
    """(scan, kind, key, ip) of rows, each once: a column of keys, or of arrays of keys, per kind.

    The keys of a host are gathered in sets, and its postings are made from these. A distinct over all postings would hold them
    in the memory of the tasks that make them, many times what the rows take.
    """
    sets = rows.groupBy(*KEY).agg(*[F.collect_set(values).alias(kind) for kind, values in kinds.items()])
    keys = lambda kind: F.array_distinct(F.flatten(kind)) if isinstance(sets.schema[kind].dataType.elementType, ArrayType) else F.col(kind)
    named = lambda kind: F.transform(keys(kind), lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key")))
    tagged = F.concat(*[named(kind) for kind in kinds])
    return sets.select(*KEY, F.explode(tagged).alias("k")).select("scan_id", "k.kind", "k.key", "ip").where("key <> ''")


def _known(values: str) -> Column:
    """An array without its nulls."""
    return F.filter(values, lambda value: value.isNotNull())


def postings(inv: Inventory) -> DataFrame:
    """Distinct (scan, kind, key, ip) of up hosts; ports, services and products of open ports.

    CVEs matched by CPE are already one row per host, and they are by far the most rows.
    Only those whose CVE also occurs in findings are deduplicated against them.
    """
    hosts = inv.hosts.where(F.col("status") == "up")
    up = hosts.select(*KEY)
    opened = inv.ports.where(F.col("state") == "open").join(up, KEY, "left_semi")
    os_words = F.filter(F.split(F.lower("os_name"), r"\s+"), lambda w: F.length(w) > 2)
    if inv.tags is None:
        of_hosts = _host_keys(hosts, os=os_words)
    else:
        of_hosts = _host_keys(with_tags(hosts, inv.tags), os=os_words, tag=_known("labels"))
    none = F.lit(None).cast("array<string>").alias("cves")
    several = [opened.select(*KEY, F.lower("product").alias("product"), none)]
    matched = None
    if inv.findings is not None:
        findings = inv.findings.join(up, KEY, "left_semi")
        several.append(findings.select(*KEY, F.lower("plugin_name").alias("product"), F.transform(_known("cves"), F.lower).alias("cves")))
    if inv.vuln_db is not None:
        # A CVE is matched on its own, so the catalogue is divided before it meets the hosts and each part is matched once.
        catalogue = inv.vuln_db.withColumn("lower_cve", F.lower("cve")).where("cve <> ''")
        match = lambda db: match_cves(opened, db.drop("lower_cve")).select("scan_id", F.lit("cve").alias("kind"), F.lower("cve").alias("key"), "ip")
        if inv.findings is None:
            matched = match(catalogue)
        else:
            shared = inv.findings.select(F.explode("cves").alias("cve")).select(F.lower("cve").alias("lower_cve")).distinct()
            reported_too = match(catalogue.join(shared, "lower_cve", "left_semi"))
            several.append(reported_too.select(*KEY, F.lit(None).cast("string").alias("product"), F.array("key").alias("cves")))
            matched = match(catalogue.join(shared, "lower_cve", "left_anti"))
    parts = [
        _host_keys(opened, port=F.col("port").cast("string"), service=F.lower("svc")), of_hosts,
        _host_keys(reduce(DataFrame.unionByName, several), product=F.col("product"), cve=F.col("cves")),
    ]
    return reduce(DataFrame.unionByName, parts if matched is None else [*parts, matched])


def posting_counts(rows: DataFrame) -> DataFrame:
    """Per kind and key: how many distinct hosts, over all scans."""
    return rows.groupBy("kind", "key", "ip").agg(F.lit(1).alias("one")).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("hosts"))


def key_counts(inv: Inventory) -> DataFrame:
    """The counts of :func:`postings` without a posting per host and matched CVE.

    Hosts are counted once for each class of CVEs (CVEs listed under the same products); a CVE's count is that of its class and the hosts beyond
    it whose findings report the CVE.
    """
    rows = postings(inv.with_tables(vuln_db=None))
    if inv.vuln_db is None:
        return posting_counts(rows)
    up = inv.hosts.where(F.col("status") == "up").select(*KEY)
    catalogue = inv.vuln_db.withColumn("cve", F.lower("cve")).where("cve <> ''")
    holders = open_products(inv.ports.join(up, KEY, "left_semi"), ["ip"]).join(class_products(catalogue), "stem").groupBy("class", "ip").agg(F.lit(1).alias("one"))
    of_class = cve_classes(catalogue).select("class", F.explode("cves").alias("key"))
    matched = of_class.join(holders.groupBy("class").agg(F.count(F.lit(1)).alias("hosts")), "class").select("key", "hosts")
    counts = posting_counts(rows.where(F.col("kind") != "cve"))
    if inv.findings is not None:
        reported = rows.where(F.col("kind") == "cve").select("key", "ip").distinct().join(of_class, "key", "left")
        beyond = reported.join(holders.select("class", "ip"), ["class", "ip"], "left_anti")
        matched = matched.unionByName(beyond.groupBy("key").agg(F.count(F.lit(1)).alias("hosts")))
    cves = matched.groupBy("key").agg(F.sum("hosts").alias("hosts"))
    return counts.unionByName(cves.select(F.lit("cve").alias("kind"), "key", "hosts"))
