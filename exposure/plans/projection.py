"""Scan-shaped tables derived from the driver's warehouse tables.

Customers become hosts, order years become scans, line items become observed
ports, events become report items, parts become the vulnerability database. Every
table is a lazy plan over the whole input, so the work grows with it.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposure.functions import columns as C
from exposure.inventory import Inventory

# Port and service by part number modulo 24, in that order.
PORTS = [22, 80, 443, 21, 23, 25, 110, 143, 161, 389, 445, 1433, 2375, 3306, 3389, 5432, 6379, 6443, 8080, 9200, 10250, 49152, 62078, 9081]
SERVICES = [
    "ssh", "http", "https", "ftp", "telnet", "smtp", "pop3", "imap", "snmp", "LDAP", "microsoft-ds", "ms-sql-s",
    "docker", "mysql", "ms-wbt-server", "postgresql", "redis", "kubernetes", "http-proxy", None, None, "tcpwrapped",
    None, "telnet",
]
OS_NAMES = [
    "Microsoft Windows Server 2019", "Linux 4.15 - 5.19", "Ubuntu 22.04", "Cisco IOS 15", "Fortinet FortiOS",
    "Apple macOS 12", None,
]
LABELS = ["ckt", "mission-critical", "crown", "choke", "pivot", "production", "staging", "p1"]
FIRST_SCAN, SCANS = 1995, 7
LATEST = 0
HOT_HOST = 7


def case_sql(index: str, values: list) -> str:
    """SQL for ``values[index]``; a None entry gives null."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values) if v is not None) + " END"


def pick(index: str, values: list) -> Column:
    return F.expr(case_sql(index, values))


def text(col: Column) -> Column:
    return col.cast("string")


class Projection:
    """Lazy scan tables over one directory of Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def host_dim(self) -> DataFrame:
        pad = lambda number: f"lpad(CAST({number} AS STRING), 2, '0')"
        return self.table("customer").selectExpr(
            "CAST(c_custkey AS BIGINT) AS host_id", "c_nationkey",
            "concat_ws('.', 10 + (c_custkey DIV 65536) % 200, c_nationkey, (c_custkey DIV 256) % 256, c_custkey % 256) AS ip",
            f"""CASE WHEN c_custkey % 3 <> 0 THEN concat_ws(':', 'aa:bb:cc', {pad('(c_custkey DIV 10000) % 100')},
                {pad('(c_custkey DIV 100) % 100')}, {pad('c_custkey % 100')}) END AS mac""",
            "lower(c_name) AS full_name", "CAST(80 + c_custkey % 21 AS INT) AS os_accuracy",
        )

    @cached_property
    def host_ips(self) -> DataFrame:
        return self.host_dim.select("host_id", "ip")

    @cached_property
    def port_rows(self) -> DataFrame:
        """First observation of each (host, scan, port, protocol), keyed by host id."""
        return self._first_ports(self._port_lines)

    @cached_property
    def port_rows_by_host(self) -> DataFrame:
        """As ``port_rows``, dealt by host and scan, so that what a scan saw of a host can be gathered where it lies."""
        return self._first_ports(self._port_lines.repartition("host_id", "scan_id"))

    @cached_property
    def _port_lines(self) -> DataFrame:
        """What each order saw of each port."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        first = "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)"
        in_order = (  # what stands for an order's lines of one port is told where they are met with the order
            self.table("lineitem").repartition("l_orderkey")
            .selectExpr("l_orderkey", f"{case_sql('l_partkey % 24', PORTS)} AS port", "CASE WHEN l_suppkey % 10 = 0 THEN 'udp' ELSE 'tcp' END AS proto", f"{first} AS first")
            .groupBy("l_orderkey", "port", "proto").agg(F.min("first").alias("first"))
            .selectExpr("l_orderkey", "port", "proto", "first.l_partkey AS part", "CASE first.l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS state")
        )
        return in_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            "CAST(o_custkey AS BIGINT) AS host_id", "year(o_orderdate) AS scan_id", "port", "proto", "part", "state", "l_orderkey"
        )

    @staticmethod
    def _first_ports(lines: DataFrame) -> DataFrame:
        seen = lines.groupBy("host_id", "scan_id", "port", "proto").agg(*[F.min_by(c, "l_orderkey").alias(c) for c in ("part", "state")])
        return seen.selectExpr(
            "host_id", "scan_id", "port", "proto",
            "CASE state WHEN 2 THEN 'closed' WHEN 1 THEN 'filtered' ELSE 'open' END AS state",
            f"{case_sql('part % 24', SERVICES)} AS svc", "CASE WHEN part % 3 = 0 THEN concat('prod', part % 24) END AS product",
            "CASE WHEN part % 6 = 0 THEN concat(part % 7, '.', part % 4) END AS version",
            "CASE WHEN part % 2 = 0 THEN concat('cpe:/a:v', part % 5, ':prod', part DIV 40, ':', part % 11) END AS cpe",
        )

    @cached_property
    def ports(self) -> DataFrame:
        return self.port_rows.join(self.host_ips, "host_id").select(
            "scan_id", "ip", "port", "proto", "state", "svc", "product", "version", "cpe"
        )

    @cached_property
    def hosts(self) -> DataFrame:
        """One row per host and scan that saw it."""
        return self.host_rows.drop("host_id")

    @cached_property
    def host_rows(self) -> DataFrame:
        """As ``hosts``, with the host id."""
        seen = self.table("lineitem").select("l_orderkey").distinct().join(
            self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
        ).select(F.col("o_custkey").cast("bigint").alias("host_id"), F.year("o_orderdate").alias("scan_id")).distinct()
        kind = "(c_nationkey + CASE WHEN (host_id + scan_id) % 5 = 0 THEN 1 ELSE 0 END) % 7"
        return seen.join(self.host_dim, "host_id").selectExpr(
            "host_id", "scan_id", "ip", "mac", "CASE WHEN (host_id + scan_id) % 4 <> 0 THEN full_name END AS hostname",
            "CASE WHEN (host_id + scan_id) % 10 = 9 THEN 'down' ELSE 'up' END AS status",
            f"{case_sql(kind, OS_NAMES)} AS os_name", "os_accuracy",
        )

    @cached_property
    def report_items(self) -> DataFrame:
        """Every report item, informational ones included; one host holds a third of them."""
        customers = self.table("customer").agg(F.count(F.lit(1))).scalar()
        plugin = F.col("event_id") % 97
        return (
            self.table("events")
            .select(
                F.when(F.col("event_id") % 3 == 0, HOT_HOST).otherwise(F.col("event_id") % customers).cast("bigint").alias("host_id"),
                (FIRST_SCAN + F.col("event_id") % SCANS).cast("int").alias("scan_id"),
                F.col("event_id").alias("finding_ord"),
                plugin.cast("int").alias("plugin_id"),
                F.concat(F.lit("Plugin "), text(plugin)).alias("plugin_name"),
                (plugin % 5).cast("int").alias("severity"),
                (plugin % 4 == 0).alias("exploit_available"),
                (plugin.cast("double") / 10).alias("cvss3"),
                pick("event_id % 3", [22, 443, 445]).alias("port"),
                F.lit("tcp").alias("proto"),
                F.concat(F.lit("CVE-2024-"), text(1000 + plugin)).alias("cve"),
                F.col("ts").alias("seen_at"),
            )
            .join(self.host_ips, "host_id").drop("host_id")
        )

    @cached_property
    def findings(self) -> DataFrame:
        """Report items of severity above 0."""
        return self.report_items.where("severity > 0").select(
            "scan_id", "ip", "finding_ord", "plugin_id", "plugin_name", "severity",
            C.severity_label(F.col("severity")).alias("severity_label"), "exploit_available",
            F.lit(None).cast("double").alias("cvss"), "cvss3", F.array("cve").alias("cves"), "port", "proto", "seen_at",
        )

    @cached_property
    def vuln_db(self) -> DataFrame:
        part = F.col("p_partkey")
        return self.table("part").select(
            F.concat(
                F.lit("cpe:2.3:a:v"), text(part % 5), F.lit(":prod"), text(F.floor(part / 40)), F.lit(":"), text(part % 11), F.lit(":*:*:*:*:*:*:*")
            ).alias("cpe"),
            part.alias("ord"),
            F.concat(F.lit("CVE-"), text(2000 + F.col("p_size") % 25), F.lit("-"), text(part)).alias("cve"),
            ((part % 101).cast("double") / 10).alias("cvss"),
            F.lit(None).cast("string").alias("severity"),
            F.col("p_name").alias("descr"),
        )

    @cached_property
    def tags(self) -> DataFrame:
        key = F.col("host_id")
        return self.host_dim.select(
            C.asset_key(F.col("mac"), F.col("ip")).alias("asset_key"),
            F.array(pick("(host_id DIV 5) % 8", LABELS)).alias("labels"),
            F.when(key % 15 == 0, "soc").alias("owner"),
            F.when(key % 35 == 0, "note").alias("notes"),
            F.col("ip").alias("last_ip"),
            F.timestamp_seconds(1700000000 + key).alias("last_seen"),
        )

    @cached_property
    def trace(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        hops = (
            self.host_dim
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("ttl", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        )
        ttl = F.col("ttl")
        second = F.when(F.col("n_nationkey") % 9 == 0, "*").otherwise(
            F.concat(F.lit("10.254."), text(F.col("n_nationkey")), F.lit(".1"))
        )
        return hops.select(
            F.lit(LATEST).alias("scan_id"), "ip", ttl.alias("hop_ord"), "ttl",
            F.when(ttl == 1, F.concat(F.lit("10.255."), text(F.col("n_regionkey")), F.lit(".1"))).when(ttl == 2, second).otherwise(F.col("ip")).alias("hop_ip"),
            F.when(ttl == 1, F.concat(F.lit("core"), text(F.col("n_regionkey")))).alias("hop_host"),
            (ttl * (1 + F.col("host_id") % 7)).cast("double").__truediv__(4).alias("rtt"),
        )

    @cached_property
    def script_hosts(self) -> DataFrame:
        """One script result and one fingerprint per host."""
        key, kind = F.col("host_id"), F.col("host_id") % 10
        month = text(1 + key % 9)
        output = {
            0: F.concat(
                F.lit("Subject: commonName="), F.col("full_name"), F.lit("\nIssuer: commonName=ca"), text(key % 3),
                F.lit("\nNot valid before: 2024-01-01T00:00:00\nNot valid after:  2026-0"), month, F.lit("-15T00:00:00"),
            ),
            1: F.concat(F.lit("Title: page "), text(key % 11)),
            2: F.lit(" nginx "),
            3: F.concat(F.lit("OS: Windows Server\nComputer name: pc"), text(key), F.lit("\nDomain name: corp")),
            4: F.concat(F.lit("\n  2048 ssh-rsa abcdefghijklmnop"), text(key), F.lit("\n  256 ssh-ed25519 zyxwvutsrqponmlk"), text(key)),
            5: F.when(key % 20 == 5, "Anonymous FTP login allowed (FTP code 230)").otherwise("refused"),
            6: F.concat(F.lit("Version: 15."), text(key % 4), F.lit("\nInstance name: SQL"), text(key % 2)),
            7: F.concat(F.lit("Version: 5.7."), text(key % 4)),
            8: F.lit("VULNERABLE"),
            9: F.lit("x"),
        }
        ids = [
            "ssl-cert", "http-title", "http-server-header", "smb-os-discovery", "ssh-hostkey", "ftp-anon", "ms-sql-info",
            "mysql-info", "smb-vuln-ms17-010", "unknown-script",
        ]
        return self.host_dim.select(
            F.lit(LATEST).alias("scan_id"), "ip", "host_id",
            F.when(key % 2 == 0, pick("host_id % 3", [443, 80, 22])).alias("port"),
            pick("host_id % 10", ids).alias("script_id"), C.case_of(kind, output).alias("output"),
            F.concat(
                F.lit("SCAN(V=7.95%E=4%OT="), text(20 + key % 5), F.lit(")\nSEQ(SP="), text(key % 13), F.lit("%TI=Z)")
            ).alias("os_fingerprint"),
            F.concat(F.lit("SF-Port"), text(key % 1000), F.lit("-TCP:V=7.95%r(GetRequest,"), text(key), F.lit(')')).alias("service_fingerprint"),
        )

    @cached_property
    def scripts(self) -> DataFrame:
        return self.script_hosts.select("scan_id", "ip", "port", "script_id", "output")

    @cached_property
    def runs(self) -> DataFrame:
        return (
            self.table("orders").groupBy(F.year("o_orderdate").alias("scan_id"))
            .agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("finished_at"))
            .withColumn("source_name", F.concat(F.lit("scan-"), text(F.col("scan_id"))))
        )

    @cached_property
    def latest_hosts(self) -> DataFrame:
        """Each host as its last scan saw it, under scan id 0."""
        last = self.hosts.groupBy("ip").agg(
            F.max(F.struct("scan_id", "mac", "hostname", "status", "os_name", "os_accuracy")).alias("h")
        )
        return last.select(
            F.lit(LATEST).alias("scan_id"), "ip", *[F.col(f"h.{c}").alias(c) for c in ("mac", "hostname", "status", "os_name", "os_accuracy")]
        )

    @cached_property
    def inventory(self) -> Inventory:
        return Inventory(
            hosts=self.hosts, ports=self.ports, findings=self.findings, scripts=self.scripts, trace=self.trace,
            tags=self.tags, vuln_db=self.vuln_db, runs=self.runs,
        )
