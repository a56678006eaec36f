"""The streaming import: reports of both scanners reach one inventory in several arrivals.

Spark writes the driver's tables as report files (``render``), eight files a scan. Nmap scans of the early years arrive first, then the
Nessus report, then the later Nmap scans by a stream with a checkpoint of its own, and last the early scans once more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

from exposure.plans import render
from exposure.plans.projection import Projection
from exposure.plans.registry import query
from exposure.session import shared_folder, shuffles_dropped
from exposure.streaming import ingest

EARLY = 1995
PARTS = 8
_imported: dict[tuple[str, str], str] = {}


def run_folder(p: Projection, name: str) -> str:
    """A fresh folder for one run, in the shared folder of the cluster; only a local session may do without one."""
    base = shared_folder(p.spark)
    if not base and not p.spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='exposure-')}/{name}-{uuid.uuid4().hex}"


def write_reports(elements: DataFrame, texts: DataFrame, path: str) -> None:
    """Whole reports: ``elements`` (scan_id, xml) between the head and the tail of their scan (scan_id, head, tail), in ``PARTS`` files each,
    compressed, as XML takes a multiple of the tables it comes from."""
    part = F.pmod(F.xxhash64("xml"), F.lit(PARTS)).cast("int")
    frame = texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    lines = elements.select("scan_id", part.alias("part"), F.lit(1).alias("place"), F.col("xml").alias("value"))
    for place, column in ((0, "head"), (2, "tail")):
        lines = lines.unionByName(frame.select("scan_id", "part", F.lit(place).alias("place"), F.col(column).alias("value")))
    lines.repartition("scan_id", "part").sortWithinPartitions("scan_id", "part", "place").drop("place").write.partitionBy("scan_id", "part").text(path, compression="gzip")


def imported(p: Projection) -> str:
    """The folder of the inventory after all arrivals; made once a session and data set."""
    key = (p.spark.sparkContext.applicationId, p.dir)
    if key not in _imported:
        folder = run_folder(p, "import")
        with shuffles_dropped(p.spark):
            _arrive(p, folder)
        _imported[key] = f"{folder}/inventory"
    return _imported[key]


def _arrive(p: Projection, folder: str) -> None:
    """Writes the reports and imports them, arrival by arrival."""
    nmap_texts = render.nmap_run_texts(p)
    early = F.col("scan_id") <= EARLY
    for name, chosen in (("early", early), ("late", ~early)):
        hosts = render.nmap_hosts(p.host_rows.where(chosen), p.port_rows_by_host.where(chosen), key=["host_id", "scan_id"])
        write_reports(hosts.select("scan_id", "xml"), nmap_texts.where(chosen), f"{folder}/{name}")
    nessus = render.nessus_hosts(p).select("scan_id", "xml")
    texts = nessus.select("scan_id").distinct().select("scan_id", F.lit('<?xml version="1.0" ?>\n<NessusClientData_v2><Report name="weekly">').alias("head"), F.lit("</Report></NessusClientData_v2>").alias("tail"))
    write_reports(nessus, texts, f"{folder}/nessus")
    for n, (landing, source) in enumerate((("early", "nmap"), ("nessus", "nessus"), ("late", "nmap"), ("early", "nmap"))):
        ingest.import_stream(p.spark, f"{folder}/{landing}", f"{folder}/inventory", f"{folder}/checkpoint-{n}", source, buckets=8).awaitTermination()


# Fragments of the SQL: what the reports hold. ``arrived`` is the order of arrival.
EVENT_HOST = "event_id % (SELECT count(*) FROM customer)"
SEEN = f"""(SELECT ip, host_id, CAST(scan_id AS DOUBLE) AS arrived, status, hostname, os_name, os_accuracy FROM host_obs
  UNION ALL SELECT ip, host_id, {EARLY}.5, 'up', CASE WHEN host_id % 4 <> 0 THEN full_name ELSE concat('NB', host_id) END,
    CASE host_id % 7 WHEN 0 THEN 'Microsoft Windows Server 2019' WHEN 1 THEN 'Linux 4.15 - 5.19' WHEN 2 THEN 'Ubuntu 22.04' WHEN 3 THEN 'Cisco IOS 15' WHEN 4 THEN 'Fortinet FortiOS' WHEN 5 THEN 'Apple macOS 12' END,
    CASE WHEN host_id % 2 = 0 THEN os_accuracy ELSE 50 END
  FROM host_dim WHERE host_id IN (SELECT {EVENT_HOST} FROM events))"""
ITEMS = f"""(SELECT ip, host_id, event_id, event_id % 97 AS plugin, CASE event_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 443 ELSE 0 END AS port,
  CASE event_id % 4 WHEN 0 THEN 'ssh' WHEN 2 THEN 'www' END AS svc FROM events JOIN host_dim ON host_id = {EVENT_HOST})"""
PORTS = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip, port, proto ORDER BY CASE WHEN product IS NULL THEN 1 ELSE 0 END, arrived) AS rn FROM (
  SELECT ip, CAST(scan_id AS DOUBLE) AS arrived, port, proto, state, svc, product FROM port_obs
  UNION ALL SELECT ip, {EARLY}.5, port, 'tcp', 'open', svc, NULL FROM (SELECT *, row_number() OVER (PARTITION BY ip, port ORDER BY event_id) AS n FROM {ITEMS} i WHERE port > 0) f WHERE n = 1) o) r WHERE rn = 1)"""
FINDINGS = f"""(SELECT ip, plugin FROM (SELECT ip, plugin, row_number() OVER (PARTITION BY ip, plugin, port ORDER BY event_id) AS rn,
  ip IN (SELECT ip FROM host_obs WHERE scan_id <= {EARLY}) AS known FROM {ITEMS} i WHERE plugin % 5 > 0) f WHERE rn = 1 OR NOT known)"""
CPES = f"""(SELECT ip, cpe FROM port_obs WHERE cpe IS NOT NULL UNION SELECT ip, 'cpe:/o:linux:linux_kernel' FROM port_obs WHERE cpe IS NOT NULL
  UNION SELECT ip, concat('cpe:/o:v', host_id % 5) FROM {ITEMS} i UNION SELECT ip, concat('cpe:/a:x', host_id % 3) FROM {ITEMS} j)"""
BEST = "arg_min({0}, struct_pack(a := -os_accuracy, b := arrived)) FILTER (os_name IS NOT NULL)"


@query(f"""SELECT s.*, coalesce(p.ports, 0) AS ports, coalesce(p.open_ports, 0) AS open_ports, coalesce(f.findings, 0) AS findings, coalesce(c.cpes, 0) AS cpes FROM (
  SELECT ip, CASE WHEN bool_or(status = 'up') THEN 'up' ELSE arg_min(status, arrived) END AS status, arg_min(struct_pack(v := hostname), arrived).v AS hostname,
    {BEST.format("os_name")} AS os_name, {BEST.format("os_accuracy")} AS os_accuracy, {BEST.format("os_name")} AS guess,
    count(*) + count(*) FILTER (arrived <= {EARLY}) AS sightings FROM {SEEN} o GROUP BY ip) s
LEFT JOIN (SELECT ip, count(*) AS ports, count(*) FILTER (state = 'open') AS open_ports FROM {PORTS} q GROUP BY ip) p ON p.ip = s.ip
LEFT JOIN (SELECT ip, count(*) AS findings FROM {FINDINGS} q GROUP BY ip) f ON f.ip = s.ip
LEFT JOIN (SELECT ip, count(*) AS cpes FROM {CPES} q GROUP BY ip) c ON c.ip = s.ip""")
def st01_streaming_import(p):
    """Every host of the merged inventory with what was merged into it, hosts without ports or findings included."""
    root = imported(p)
    inv = ingest.current_inventory(p.spark, root)
    hosts = inv.hosts.select("ip", "status", "hostname", "os_name", "os_accuracy", F.get("os", F.lit(0))["name"].alias("guess"), "sightings")
    counted = [
        inv.ports.groupBy("ip").agg(F.count(F.lit(1)).alias("ports"), F.count_if(F.col("state") == "open").alias("open_ports")),
        inv.findings.groupBy("ip").agg(F.count(F.lit(1)).alias("findings")),
        ingest.current(p.spark, root, "cpes").groupBy("ip").agg(F.count(F.lit(1)).alias("cpes")),
    ]
    for counts in counted:
        hosts = hosts.join(counts, "ip", "left")
    return hosts.fillna(0, ["ports", "open_ports", "findings", "cpes"])


@query(f"""SELECT concat('nmap -oX ', source_name, ' "net"') AS name, 'nmap' AS type, CAST({PARTS} * CASE WHEN r.scan_id <= {EARLY} THEN 2 ELSE 1 END AS BIGINT) AS files,
  (SELECT count(*) FROM host_obs h WHERE h.scan_id = r.scan_id) * CASE WHEN r.scan_id <= {EARLY} THEN 2 ELSE 1 END AS hosts, epoch(CAST(started_at AS TIMESTAMP))::BIGINT AS imported_at FROM scan_run r
UNION ALL SELECT 'weekly', 'nessus', CAST({PARTS} * (SELECT count(DISTINCT event_id // (SELECT count(*) FROM customer) // 16) FROM events) AS BIGINT),
  (SELECT count(*) FROM (SELECT DISTINCT host_id, event_id // (SELECT count(*) FROM customer) // 16 AS c FROM {ITEMS} i) d), NULL""")
def st01_import_registry(p):
    """The registry of imported files, by report."""
    sources = ingest.current(p.spark, imported(p), "sources")
    by_name = sources.groupBy("name", "type").agg(F.count(F.lit(1)).alias("files"), F.sum("hosts").alias("hosts"), F.max("imported_at").alias("imported_at"))
    return by_name.withColumn("imported_at", F.unix_seconds("imported_at"))


PER_IP = f"""(SELECT ip, bool_or(arrived < {EARLY}.5) AS e, bool_or(arrived = {EARLY}.5) AS n, bool_or(arrived > {EARLY}.5) AS l, bool_or(arrived < {EARLY}.5 AND status = 'up') AS e_up, bool_or(status = 'up') AS up FROM {SEEN} o GROUP BY ip)"""
REPORT = "SELECT {0} AS arrival, count(*) FILTER ({1}) AS added, count(*) FILTER ({2}) AS updated, {3} AS findings, count(*) FILTER ({4}) AS total, count(*) FILTER ({5}) AS up, count(*) FILTER (({4}) AND NOT ({5})) AS down FROM " + PER_IP + " t"


@query("\nUNION ALL ".join((
    REPORT.format(1, "e", "false", "CAST(0 AS BIGINT)", "e", "e_up"),
    REPORT.format(2, "n AND NOT e", "n AND e", f"(SELECT count(*) FROM {ITEMS} i WHERE plugin % 5 > 0)", "n OR e", "n OR e_up"),
    REPORT.format(3, "l AND NOT (n OR e)", "l AND (n OR e)", "0", "true", "up"),
    REPORT.format(4, "false", "e", "0", "true", "up"),
)))
def st01_import_reports(p):
    """What each arrival added and updated, and how the inventory stood after it."""
    return ingest.import_reports(p.spark, imported(p)).withColumn("arrival", F.col("arrival").cast("int"))


@query(f"""SELECT CASE plugin % 5 WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity_label, count(*) AS findings, count(*) FILTER (plugin % 4 = 0) AS exploitable
FROM {FINDINGS} f GROUP BY plugin % 5""")
def st02_live_severity_counts(p):
    """Findings of the merged inventory by severity: sums of what the batches changed."""
    return ingest.severity_totals(p.spark, imported(p))


@query(f"""SELECT (SELECT count(DISTINCT ip) FROM {SEEN} o) AS hosts, (SELECT count(DISTINCT ip) FROM {SEEN} o WHERE status = 'up') AS up,
  count(*) FILTER (state = 'open') AS open_ports, count(*) FILTER (state = 'open' AND coalesce(d.port_cleartext, s.svc_cleartext) IS NOT NULL) AS cleartext_services
FROM {PORTS} p LEFT JOIN port_dim_web d ON d.port = p.port LEFT JOIN service_dim_web s ON s.svc_key = p.svc""")
def st02_live_exposure_counts(p):
    """Hosts, open ports and cleartext services of the merged inventory: sums of what the batches changed."""
    return ingest.exposure_totals(p.spark, imported(p))
