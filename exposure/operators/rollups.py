"""Fleet roll-ups over ports and services, and the per-host count card.

Group members are long tables or bounded previews, never one unbounded list: a
port such as 443 may be open on a third of all hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from exposure import dims
from exposure.functions import columns as C
from exposure.operators.risk import with_port_risk

KEY = C.HOST_KEY


def exposed_ports(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Open ports of up hosts."""
    up = hosts.where(F.col("status") == "up").select(*KEY)
    return ports.where(F.col("state") == "open").join(up, KEY, "left_semi")


def card_severity(admin_severity: Column, is_admin: Column, is_cleartext: Column) -> Column:
    return (
        F.when(admin_severity == "critical", "critical").when(is_admin, "warning").when(is_cleartext, "cleartext").otherwise("")
    )


def port_rollup(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Per scan and port: instances, hosts, the first host's service and product, flags, severity.

    Distinct hosts are counted in two steps, (port, IP) first, so a popular port is
    spread over many tasks.
    """
    admin = F.broadcast(dims.admin_dim(ports.sparkSession).select("port", "admin_name", "admin_severity"))
    facts = with_port_risk(exposed_ports(hosts, ports)).select(
        "scan_id", "ip", "port", F.struct("ip", "proto", "svc", "product", "cleartext_name").alias("seen")
    )
    per_host = facts.groupBy("scan_id", "port", "ip").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    per_port = per_host.groupBy("scan_id", "port").agg(
        F.sum("n").alias("instances"), F.count(F.lit(1)).alias("hosts"), F.min("seen").alias("seen")
    )
    return per_port.join(admin, "port", "left").select(
        "scan_id", "port",
        F.coalesce("seen.svc", F.lit("unknown")).alias("service"), F.col("seen.product").alias("product"),
        "instances", "hosts",
        F.col("admin_name").isNotNull().alias("is_admin"), F.col("seen.cleartext_name").isNotNull().alias("is_cleartext"),
        F.col("seen.cleartext_name").alias("cleartext_name"),
        card_severity(F.col("admin_severity"), F.col("admin_name").isNotNull(), F.col("seen.cleartext_name").isNotNull()).alias("card_severity"),
    )


def service_rollup(hosts: DataFrame, ports: DataFrame, preview: int = 5) -> DataFrame:
    """Per scan and lower-cased service: ports, hosts, products, flags and severity.

    Port numbers are a 16-bit domain, so the set of ports per service is bounded;
    hosts and products are only counted. The distinct counts group by (service, host) and
    (service, product) first, in the same pass over the ports.
    """
    spark = ports.sparkSession
    admin = F.broadcast(dims.admin_dim(spark).select("port", "admin_severity"))
    port_clear = F.broadcast(dims.port_dim(spark).select("port", "port_cleartext"))
    svc_clear = F.broadcast(dims.service_dim(spark).select(F.col("svc_key").alias("service"), "svc_cleartext"))
    facts = (
        exposed_ports(hosts, ports).where(F.col("svc").isNotNull())
        .select("scan_id", F.lower("svc").alias("service_key"), "ip", "port", "proto", "svc", "product")
        .join(admin, "port", "left").join(port_clear, "port", "left")
    )
    rolled = facts.groupBy("scan_id", "service_key").agg(
        F.min(F.struct("ip", "port", "proto", "svc")).getField("svc").alias("service"),
        F.sort_array(F.collect_set("port")).alias("port_set"),
        F.count_distinct("ip").alias("hosts"), F.count_distinct("product").alias("products"),
        F.max(F.col("admin_severity") == "critical").alias("any_critical"),
        F.count("admin_severity").alias("admin_ports"), F.count("port_cleartext").alias("cleartext_ports"),
    )
    joined = rolled.withColumn("ports", F.size("port_set").cast("bigint")).join(svc_clear, "service", "left")
    listed = F.array_join(F.transform(F.slice("port_set", 1, preview), lambda p: p.cast("string")), ", ")
    is_clear = (F.col("cleartext_ports") > 0) | F.col("svc_cleartext").isNotNull()
    critical = F.when(F.coalesce("any_critical", F.lit(False)), "critical")
    return joined.select(
        "scan_id", "service_key", "service", "ports", "hosts", "products",
        F.concat(listed, F.when(F.col("ports") > preview, "...").otherwise("")).alias("port_list"),
        card_severity(critical, F.col("admin_ports") > 0, is_clear).alias("card_severity"),
    )


def cleartext_services(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Every cleartext service on an up host."""
    return with_port_risk(exposed_ports(hosts, ports)).where("is_cleartext").select(
        "scan_id", "ip", "port", "proto", "svc", "cleartext_name"
    )


def cleartext_rollup(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Per scan and protocol: instances and hosts."""
    per_host = cleartext_services(hosts, ports).groupBy("scan_id", "cleartext_name", "ip").agg(F.count(F.lit(1)).alias("n"))
    return per_host.groupBy("scan_id", "cleartext_name").agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("hosts"))


def cleartext_totals(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Per scan: cleartext instances and the hosts they are on."""
    per_host = cleartext_services(hosts, ports).groupBy("scan_id", "ip").agg(F.count(F.lit(1)).alias("n"))
    return per_host.groupBy("scan_id").agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("hosts"))


def admin_ports(ports: DataFrame) -> DataFrame:
    """Open administrative ports with their interface; ``admin_rank`` 0 is critical."""
    admin = F.broadcast(dims.admin_dim(ports.sparkSession))
    return ports.where(F.col("state") == "open").join(admin, "port").select(
        *KEY, "port", "proto", "admin_name", "admin_category", "admin_severity", "admin_rank", "admin_description"
    )


def host_counts(inventory, cves: DataFrame | None = None) -> DataFrame:
    """Per host: ports, cleartext, admin ports, findings by severity, CVEs, script vulnerabilities and risk.

    Each child table is reduced to one row per host before it is joined.
    """
    from exposure.operators.risk import score_hosts
    from exposure.operators.scripts import vulnerability_scripts
    from exposure.operators.vulns import count_cves

    scored = score_hosts(inventory.hosts, inventory.ports, inventory.findings)
    admin = admin_ports(inventory.ports).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("admin_ports"), F.count_if(F.col("admin_rank") <= 1).alias("critical_admin_ports")
    )
    per_host = count_cves(inventory.ports, inventory.vuln_db) if cves is None else cves.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cves"))
    counts = [admin, per_host]
    if inventory.scripts is not None:
        counts.append(vulnerability_scripts(inventory.scripts).groupBy(*KEY).agg(F.count(F.lit(1)).alias("script_vulns")))
    out = scored
    for child in counts:
        out = out.join(child, KEY, "left")
    extra = [c for child in counts for c in child.columns if c not in KEY]
    return out.select(*scored.columns, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in extra])
