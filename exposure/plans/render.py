"""Scanner reports and feeds written out from the projected tables.

The readers are checked at scale on documents Spark derives from the driver's tables:
one XML element per host, one JSON page per hundred parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposure.functions import columns as C
from exposure.plans.projection import LATEST, OS_NAMES, Projection, pick, text

KEY = C.HOST_KEY
ITEMS_PER_REPORT = 16
PER_PAGE = 100


def _array_of(df: DataFrame, order: list[str], item, name: str, key: list[str] = KEY) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), item.alias("v"))))
    return df.groupBy(*key).agg(F.transform(rows, lambda x: x["v"]).alias(name))


def _script_items(df: DataFrame, name: str) -> DataFrame:
    item = F.struct(F.col("script_id").alias("_id"), F.col("output").alias("_output"))
    return _array_of(df, ["script_id"], item, name)


def nmap_hosts(hosts: DataFrame, ports: DataFrame | None = None, scripts: DataFrame | None = None, trace: DataFrame | None = None, key: list[str] = KEY) -> DataFrame:
    """``scan_id``, ``host_ord`` and ``xml``: one ``<host>`` element per host. Hosts and ports meet by ``key``."""
    out = hosts
    if ports is not None:
        service = F.struct(
            F.col("svc").alias("_name"), F.col("product").alias("_product"), F.col("version").alias("_version"),
            F.when(F.col("cpe").isNotNull(), F.array(F.col("cpe"), F.lit("cpe:/o:linux:linux_kernel"))).alias("cpe"),
        )
        port = F.struct(
            F.col("proto").alias("_protocol"), text(F.col("port")).alias("_portid"), F.struct(F.col("state").alias("_state")).alias("state"), service.alias("service")
        )
        out = out.join(_array_of(ports, ["port", "proto"], port, "port_items", key), key, "left")
    else:
        out = out.withColumn("port_items", F.lit(None).cast("array<struct<_protocol:string>>"))
    if scripts is not None:
        out = out.join(_script_items(scripts, "script_items"), KEY, "left")
    if trace is not None:
        hop = F.struct(text(F.col("ttl")).alias("_ttl"), F.col("hop_ip").alias("_ipaddr"), F.col("hop_host").alias("_host"), F.when(F.col("ttl") == 2, "--").otherwise(text(F.col("rtt"))).alias("_rtt"))
        out = out.join(_array_of(trace, ["hop_ord"], hop, "hop_items"), KEY, "left")
    address = F.array_compact(F.array(
        F.struct(F.concat(F.lit("fe80::"), text(F.length("ip"))).alias("_addr"), F.lit("ipv6").alias("_addrtype")),
        F.struct(F.col("ip").alias("_addr"), F.lit("ipv4").alias("_addrtype")),
        F.when(F.col("mac").isNotNull(), F.struct(F.col("mac").alias("_addr"), F.lit("mac").alias("_addrtype"))),
    ))
    element = [
        F.struct(F.col("status").alias("_state")).alias("status"), address.alias("address"),
        F.when(F.col("hostname").isNotNull(), F.struct(F.array(F.struct(F.col("hostname").alias("_name"))).alias("hostname"))).alias("hostnames"),
        F.when(F.col("port_items").isNotNull(), F.struct(F.col("port_items").alias("port"))).alias("ports"),
        F.when(
            F.col("os_name").isNotNull(),
            F.struct(F.array(F.struct(F.col("os_name").alias("_name"), text(F.col("os_accuracy")).alias("_accuracy"))).alias("osmatch")),
        ).alias("os"),
    ]
    if scripts is not None:
        element.append(F.when(F.col("script_items").isNotNull(), F.struct(F.col("script_items").alias("script"))).alias("hostscript"))
    if trace is not None:
        element.append(F.when(F.col("hop_items").isNotNull(), F.struct(F.col("hop_items").alias("hop"))).alias("trace"))
    return out.select("scan_id", F.lit(0).alias("host_ord"), F.to_xml(F.struct(*element), {"rowTag": "host"}).alias("xml"))


def nmap_run_texts(p: Projection) -> DataFrame:
    """Head and tail of one Nmap report per scan; odd scans lack the closing statistics."""
    start = F.unix_seconds(F.col("started_at").cast("timestamp"))
    head = F.concat(
        F.lit('<?xml version="1.0"?>\n<!DOCTYPE nmaprun>\n<nmaprun scanner="nmap" args="nmap -oX '), F.col("source_name"),
        F.lit(' &quot;net&quot;" start="'), text(start), F.lit('" startstr="day" version="7.95">\n<hosthint><status state="up"/></hosthint>'),
    )
    tail = F.concat(F.lit('<runstats><finished time="1" timestr="end"/><hosts up="'), text(F.col("scan_id") % 100), F.lit('" down="5" total="'), text(F.col("scan_id")), F.lit('"/></runstats>\n</nmaprun>'))
    return p.runs.select("scan_id", head.alias("head"), F.when(F.col("scan_id") % 2 == 0, tail).otherwise("</nmaprun>").alias("tail"))


def nessus_hosts(p: Projection) -> DataFrame:
    """One ``<ReportHost>`` element per host and sixteen report items."""
    customers = p.table("customer").agg(F.count(F.lit(1))).scalar()
    event, plugin = F.col("event_id"), F.col("event_id") % 97
    item = F.struct(
        event.alias("at"), text(pick("event_id % 3", [22, 443, 0])).alias("_port"), F.lit("tcp").alias("_protocol"),
        pick("event_id % 4", ["ssh", "?", "www", None]).alias("_svc_name"), text(plugin).alias("_pluginID"),
        F.concat(F.lit("Plugin <"), text(plugin), F.lit(">")).alias("_pluginName"), text(plugin % 5).alias("_severity"),
        F.lit("High & low").alias("risk_factor"), F.when(plugin % 3 != 0, text(plugin.cast("double") / 10)).otherwise("n/a").alias("cvss3_base_score"),
        F.when(plugin % 4 == 0, "true").otherwise("false").alias("exploit_available"),
        F.array(F.concat(F.lit("CVE-2024-"), text(1000 + plugin)), F.concat(F.lit("CVE-2023-"), text(1000 + plugin))).alias("cve"),
    )
    per_host = p.table("events").select((event % customers).alias("host_id"), F.floor(F.floor(event / customers) / ITEMS_PER_REPORT).cast("int").alias("scan_id"), item.alias("item"))
    grouped = per_host.groupBy("host_id", "scan_id").agg(F.transform(F.sort_array(F.collect_list("item")), lambda i: i.dropFields("at")).alias("items"))
    key = F.col("host_id")
    tag = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("_name"), value.alias("_VALUE")))
    tags = F.array_compact(F.array(
        tag("host-ip", F.col("ip")), tag("hostname", F.when(key % 4 != 0, F.col("full_name"))), tag("netbios-name", F.concat(F.lit("NB"), text(key))),
        tag("operating-system", pick("host_id % 7", OS_NAMES)), tag("operating-system-conf", F.when(key % 2 == 0, text(F.col("os_accuracy")))),
        tag("cpe", F.concat(F.lit("cpe:/o:v"), text(key % 5))), tag("cpe-0", F.concat(F.lit("cpe:/o:v"), text(key % 5))), tag("cpe-1", F.concat(F.lit("cpe:/a:x"), text(key % 3))),
        tag("cpe-extra", F.lit("ignored")),
        tag("traceroute-hop-1", F.col("ip")), tag("traceroute-hop-0", F.concat(F.lit("10.255."), text(F.col("c_nationkey")), F.lit(".1"))),
        tag("Credentialed_Scan", F.when(key % 3 == 0, "true").otherwise("false")),
    ))
    host = F.struct(F.concat(F.lit("name-"), F.col("ip")).alias("_name"), F.struct(tags.alias("tag")).alias("HostProperties"), F.col("items").alias("ReportItem"))
    return grouped.join(p.host_dim, "host_id").select("scan_id", F.lit(0).alias("host_ord"), F.to_xml(host, {"rowTag": "ReportHost"}).alias("xml"))


def nvd_pages(p: Projection) -> DataFrame:
    """NVD API pages of a hundred CVEs as JSON text."""
    part = F.col("p_partkey")
    metric = lambda cond: F.when(cond, F.array(F.struct(F.struct(((part % 100).cast("double") / 10).alias("baseScore")).alias("cvssData"))))
    cpe = lambda v: F.concat(F.lit("cpe:2.3:a:v"), text(part % 5), F.lit(":prod"), text(part % 24), F.lit(f":{v}:*:*:*:*:*:*:*"))
    match = lambda v, flag: F.struct(F.lit(flag).alias("vulnerable"), cpe(v).alias("criteria"))
    node = lambda *matches: F.struct(F.array(*matches).alias("cpeMatch"))
    configurations = F.when(
        part % 11 != 0,
        F.array(F.struct(F.array(node(match("1.0", True), match("2.0", False)), node(match("1.0", True))).alias("nodes")), F.struct(F.array(node(match("3.0", True))).alias("nodes"))),
    )
    english = F.when(part % 5 != 0, F.struct(F.lit("en").alias("lang"), F.repeat(F.col("p_name"), F.lit(30)).alias("value")))
    cve = F.struct(
        F.concat(F.lit("CVE-2024-"), text(part)).alias("id"),
        F.concat(text(F.date_add(F.lit("2024-01-01").cast("date"), (part % 400).cast("int"))), F.lit("T10:15:08.100")).alias("published"),
        F.struct(metric(part % 3 == 0).alias("cvssMetricV31"), metric((part % 3 == 1) | (part % 6 == 0)).alias("cvssMetricV30"), metric(part % 3 != 1).alias("cvssMetricV2")).alias("metrics"),
        F.array_compact(F.array(F.struct(F.lit("es").alias("lang"), F.lit("hola").alias("value")), english)).alias("descriptions"),
        configurations.alias("configurations"),
    )
    rows = p.table("part").select(F.floor(part / PER_PAGE).alias("page"), F.struct(cve.alias("cve")).alias("v"))
    return rows.groupBy("page").agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("totalResults"), F.collect_list("v").alias("vulnerabilities"))).alias("json")
    )


def vuln_db_documents(p: Projection) -> DataFrame:
    """Database objects over a hundred parts each, mixing both field spellings; some CPEs are empty."""
    doc = F.floor(F.col("ord") / PER_PAGE)
    even = F.col("ord") % 2 == 0
    entry = F.struct(
        "cve", F.when(even, F.col("cvss")).alias("cvss"), F.when(~even, "HIGH").alias("severity"),
        F.when(even, F.col("descr")).alias("desc"), F.when(~even, F.col("descr")).alias("description"),
    )
    rows = p.vuln_db.select(doc.alias("doc"), "cpe", "ord", entry.alias("e"))
    per_cpe = rows.groupBy("doc", "cpe").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "e"))), lambda x: x["e"]).alias("entries"))
    empty = per_cpe.select("doc").distinct().select(
        "doc", F.concat(F.lit("cpe:2.3:a:none:c"), text(F.col("doc")), F.lit(":*")).alias("cpe"), F.array().cast(per_cpe.schema["entries"].dataType).alias("entries")
    )
    both = per_cpe.unionByName(empty)
    return both.groupBy("doc").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("cpe", "entries")))).alias("json"))


def tag_documents(p: Projection) -> DataFrame:
    """Tag objects over a thousand hosts each; every second record has the old bare-IP form."""
    tags = p.tags.join(p.host_ips.withColumnRenamed("ip", "last_ip"), "last_ip")
    old = F.col("host_id") % 2 == 1
    record = F.to_json(F.struct("labels", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("notes", F.lit("")).alias("notes"), F.col("last_ip").alias("lastIp"), F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastSeen")))
    member = F.concat(F.lit('"'), F.when(old, F.col("last_ip")).otherwise(F.col("asset_key")), F.lit('": '), F.when(old, F.to_json("labels")).otherwise(record))
    return tags.groupBy(F.floor(F.col("host_id") / 1000).alias("doc")).agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(member), ", "), F.lit("}")).alias("json")
    )
