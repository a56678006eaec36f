"""Queries that relate tables: joins, scan differences, timeline, merges, tags, graph, scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure import schemas
from exposure.functions import columns as C
from exposure.operators import diff, merge, rollups, scripts, tags, topology, vulns
from exposure.operators.risk import with_port_risk
from exposure.plans.projection import Projection
from exposure.plans.registry import query
from exposure.sinks import exports

KEY = C.HOST_KEY


def edit_time():
    """The time the tag edits below are stamped with."""
    return F.timestamp_seconds(F.lit(1800000000))


# ------------------------------------------------------------------ joins
@query("SELECT f.scan_id, f.ip, f.port, f.proto, f.cleartext_name, CAST(f.score AS INT) AS score_weight FROM port_facts_web f WHERE score > 0")
def jn01_port_lookup(p):
    return with_port_risk(p.ports).where("score_weight > 0").select(*KEY, "port", "proto", "cleartext_name", "score_weight")


@query("""SELECT scan_id, ip, port, proto, admin_name, admin_category, admin_severity, CAST(admin_rank AS INT) AS admin_rank, admin_description
FROM port_obs JOIN admin_dim USING (port) WHERE state = 'open'""")
def jn02_admin_ports(p):
    return rollups.admin_ports(p.ports).orderBy("scan_id", "ip", "admin_rank", "port", "proto")


@query("SELECT scan_id, ip, coalesce(label, '') AS labels, owner, notes FROM host_label")
def jn03_host_tags(p):
    return tags.with_tags(p.hosts, p.tags).select(*KEY, F.coalesce(F.array_join("labels", ";"), F.lit("")).alias("labels"), "owner", "notes")


@query("""SELECT scan_id, ip, min(port) AS port, o.cpe, cve, cvss FROM port_obs o JOIN (SELECT replace(replace(cpe, ':*:*:*:*:*:*:*', ''), 'cpe:2.3:', 'cpe:/') AS cpe, cve, cvss FROM vuln_db) v ON o.cpe = v.cpe
WHERE state = 'open' GROUP BY ALL""")
def jn04_cve_exact(p):
    db = p.vuln_db.withColumn("cpe", F.replace(F.replace("cpe", F.lit(":*:*:*:*:*:*:*"), F.lit("")), F.lit("cpe:2.3:"), F.lit("cpe:/")))
    return vulns.match_exact(p.ports, db).select(*KEY, "port", "cpe", "cve", "cvss")


@query("SELECT scan_id, ip, cve, cvss, port, cpe, match, descr FROM cve_match")
def jn05_cve_match(p):
    return vulns.match_cves(p.ports, p.vuln_db).drop("cvss_class")


@query("""SELECT scan_id, ip, cve, cvss, port, cpe, match FROM (
  SELECT o.scan_id, o.ip, v.cve, v.cvss, o.port, v.cpe, CASE WHEN o.cpe = v.cpe THEN 'exact' ELSE 'prefix' END AS match,
    row_number() OVER (PARTITION BY o.scan_id, o.ip, v.cve ORDER BY o.port, CASE WHEN o.cpe = v.cpe THEN 0 ELSE 1 END, v.cpe, v.ord) AS rn
  FROM (SELECT scan_id, ip, concat(replace(cpe, 'cpe:/', 'cpe:2.3:'), ':*:*:*:*:*:*:*') AS cpe, min(port) AS port FROM port_obs WHERE state = 'open' AND cpe IS NOT NULL GROUP BY ALL) o
  JOIN vuln_db v ON starts_with(v.cpe, array_to_string(list_slice(string_split(o.cpe, ':'), 1, 5), ':'))) m WHERE rn = 1""")
def jn05_cve_match_literal(p):
    """Hosts against the database by the literal prefix rule, exact hits first; ports report CPEs in the database's form."""
    ports = p.ports.withColumn("cpe", F.concat(C.cpe_23(F.col("cpe")), F.lit(":*:*:*:*:*:*:*")))
    return vulns.match_cves(ports, p.vuln_db, "literal").drop("cvss_class", "descr")


LITERAL_SQL = """SELECT o.cpe, v.cpe AS db_cpe, CASE WHEN o.cpe = v.cpe THEN 'exact' ELSE 'prefix' END AS match
FROM (SELECT DISTINCT cpe, array_to_string(list_slice(string_split(cpe, ':'), 1, 5), ':') AS base FROM (
    SELECT cpe FROM port_obs WHERE cpe IS NOT NULL UNION ALL SELECT replace(cpe, 'cpe:/', 'cpe:2.3:') FROM port_obs WHERE cpe IS NOT NULL UNION ALL SELECT 'cpe:2.3:a' UNION ALL SELECT cpe FROM vuln_db) u) o
JOIN (SELECT DISTINCT cpe FROM vuln_db) v ON starts_with(v.cpe, o.base)"""


@query(LITERAL_SQL)
def jn05_cve_prefix_literal(p):
    """The literal prefix rule over 2.2 and 2.3 port CPEs, a bare part and the database's own keys."""
    own = p.ports.where("cpe IS NOT NULL").select("cpe")
    bare = p.spark.range(1).select(F.lit("cpe:2.3:a").alias("cpe"))
    cpes = own.unionByName(own.select(C.cpe_23(F.col("cpe")).alias("cpe"))).unionByName(bare).unionByName(p.vuln_db.select("cpe"))
    return vulns.cpe_pairs(cpes, p.vuln_db, "literal")


@query("""SELECT base_id, comp_id, ip, in_base, in_comp, base_os, comp_os, base_status, comp_status FROM host_pair""")
def jn06_diff_hosts(p):
    seen = F.col("seen")
    return diff.host_sides(p.hosts, diff.consecutive_pairs(p.runs)).select(
        "base_id", "comp_id", "ip", (seen != diff.COMP).alias("in_base"), (seen != diff.BASE).alias("in_comp"), "base_os", "comp_os", "base_status", "comp_status"
    )


@query("SELECT base_id, comp_id, ip, CASE WHEN in_comp THEN 'new' ELSE 'removed' END AS diff FROM host_pair WHERE in_base <> in_comp")
def jn07_added_removed_hosts(p):
    sides = diff.host_sides(p.hosts, diff.consecutive_pairs(p.runs)).where(F.col("seen") != diff.BOTH)
    return sides.select("base_id", "comp_id", "ip", F.when(F.col("seen") == diff.COMP, "new").otherwise("removed").alias("diff"))


@query("SELECT base_id, comp_id, ip, port, proto FROM port_change WHERE type = 'port_added'")
def jn07_added_ports(p):
    return diff.added_ports(p.ports, diff.consecutive_pairs(p.runs))


@query("SELECT base_id, comp_id, ip, port, proto FROM port_change WHERE type = 'port_removed'")
def jn07_removed_ports(p):
    return diff.removed_ports(p.ports, diff.consecutive_pairs(p.runs))


@query("SELECT t.asset_key, t.last_ip, l.ip AS host_ip, l.mac AS host_mac, l.hostname FROM asset_tag t LEFT JOIN latest_host l ON l.host_id = t.host_id")
def jn08_tag_hosts(p):
    return tags.host_of_tag(p.tags, p.latest_hosts).select("asset_key", "last_ip", "host_ip", "host_mac", "hostname")


# ------------------------------------------------------------------ differences and timeline
CHANGE_COLUMNS = "base_id, comp_id, ip, type, port, from_value, to_value"


@query(f"SELECT {CHANGE_COLUMNS} FROM change_row WHERE type IN ('port_added', 'port_removed')")
def df01_port_changes(p):
    return diff.port_changes(p.hosts, p.ports, diff.consecutive_pairs(p.runs))


@query(f"SELECT {CHANGE_COLUMNS} FROM change_row WHERE type = 'os_changed'")
def df02_os_changes(p):
    return diff.os_changes(p.hosts, diff.consecutive_pairs(p.runs))


@query(f"SELECT {CHANGE_COLUMNS} FROM change_row WHERE type = 'status_changed'")
def df03_status_changes(p):
    return diff.status_changes(p.hosts, diff.consecutive_pairs(p.runs))


@query("SELECT base_id, comp_id, ip, diff, changes FROM host_diff")
def df04_host_diff(p):
    return diff.host_diff(p.hosts, p.ports, diff.consecutive_pairs(p.runs))


@query(f"SELECT {CHANGE_COLUMNS} FROM change_row")
def df05_change_log(p):
    return diff.change_log(p.hosts, p.ports, diff.consecutive_pairs(p.runs))


SUMMARY = """SELECT base_id, comp_id, count(*) FILTER (diff = 'new') AS new_hosts, count(*) FILTER (diff = 'removed') AS removed_hosts,
  count(*) FILTER (diff = 'changed') AS changed_hosts, count(*) FILTER (diff = 'unchanged') AS unchanged_hosts FROM host_diff GROUP BY base_id, comp_id"""


@query(SUMMARY)
def ag17_diff_summary(p):
    return diff.diff_summary(p.hosts, p.ports, diff.consecutive_pairs(p.runs))


@query("SELECT * FROM scan_total")
def tl01_scan_series(p):
    return diff.scan_series(p.runs, p.hosts, p.ports)


@query("""SELECT scan_id, started_at, round(hosts_up / (SELECT max(hosts_up) FROM scan_total) * 150, 6) AS host_height, round(open_ports / (SELECT max(open_ports) FROM scan_total) * 150, 6) AS port_height
FROM scan_total""")
def tl02_scan_trend(p):
    return diff.scan_trend(diff.scan_series(p.runs, p.hosts, p.ports))


@query(f"""SELECT s.*, b.started_at AS from_time, c.started_at AS to_time FROM ({SUMMARY}) s JOIN scan_run b ON b.scan_id = s.base_id JOIN scan_run c ON c.scan_id = s.comp_id
WHERE s.new_hosts > 0 OR s.removed_hosts > 0 OR s.changed_hosts > 0""")
def tl03_timeline_changes(p):
    return diff.timeline_changes(p.runs, p.hosts, p.ports)


# ------------------------------------------------------------------ merges
def loads(df):
    """Scans in the order they were run, as load order."""
    return df.withColumn("load_ord", F.col("scan_id").cast("bigint"))


MERGED_SQL = """SELECT 0 AS scan_id, ip, {first}, max_by(os_name, os_accuracy * 10000 - scan_id) FILTER (os_name IS NOT NULL) AS os_name,
  max_by(os_accuracy, os_accuracy * 10000 - scan_id) FILTER (os_name IS NOT NULL) AS os_accuracy,
  CAST(min(scan_id) AS BIGINT) AS first_load, CAST(max(scan_id) AS BIGINT) AS last_load, count(*) AS sightings FROM host_obs GROUP BY ip"""


@query(f"""SELECT m.scan_id, m.ip, m.mac, h.hostname, m.status, m.os_name, m.os_accuracy, m.first_load, m.last_load, m.sightings FROM (
{MERGED_SQL.format(first="min_by(mac, scan_id) AS mac, CASE WHEN bool_or(status = 'up') THEN 'up' ELSE min_by(status, scan_id) END AS status")}) m
JOIN host_obs h ON h.ip = m.ip AND h.scan_id = m.first_load""")
def mg01_merge_hosts(p):
    return merge.merge_hosts(loads(p.hosts))


@query(MERGED_SQL.format(first="max(mac) AS mac, min_by(hostname, scan_id) FILTER (hostname IS NOT NULL) AS hostname, min_by(status, scan_id) AS status"))
def mg01_merge_hosts_desktop(p):
    return merge.merge_hosts(loads(p.hosts), "desktop")


@query("""SELECT 0 AS scan_id, ip, port, proto, state, svc, product, version, cpe FROM (
  SELECT *, row_number() OVER (PARTITION BY ip, port, proto ORDER BY CASE WHEN product IS NULL THEN 1 ELSE 0 END, scan_id) AS rn FROM port_obs) r WHERE rn = 1""")
def mg02_merge_ports(p):
    return merge.merge_ports(loads(p.ports))


@query("""SELECT 0 AS scan_id, ip, port, proto, state, svc, product, version, cpe FROM (
  SELECT *, row_number() OVER (PARTITION BY ip, port, proto ORDER BY scan_id) AS rn FROM port_obs) r WHERE rn = 1""")
def mg02_merge_ports_desktop(p):
    return merge.merge_ports(loads(p.ports), "desktop")


@query("""SELECT ip, max_by(os_name, os_accuracy * 10000 - scan_id) FILTER (os_name IS NOT NULL) AS os_name, max_by(os_accuracy, os_accuracy * 10000 - scan_id) FILTER (os_name IS NOT NULL) AS os_accuracy,
  CAST(min(scan_id) FILTER (os_name IS NOT NULL) AS BIGINT) AS from_load FROM host_obs GROUP BY ip""")
def mg03_merge_os(p):
    return merge.merge_os(loads(p.hosts))


@query("""SELECT 0 AS scan_id, f.ip, f.plugin_id, f.port, f.finding_ord, CAST(f.scan_id AS BIGINT) AS load_ord, f.severity FROM (
  SELECT f.*, h.first_scan, row_number() OVER (PARTITION BY f.ip, f.plugin_id, f.port ORDER BY f.scan_id, f.finding_ord) AS rn
  FROM finding f JOIN (SELECT ip, min(scan_id) AS first_scan FROM (SELECT ip, scan_id FROM host_obs UNION ALL SELECT ip, scan_id FROM finding) s GROUP BY ip) h ON h.ip = f.ip) f WHERE rn = 1 OR f.scan_id = f.first_scan""")
def mg04_merge_findings(p):
    return merge.merge_findings(loads(p.findings), loads(p.hosts)).select("scan_id", "ip", "plugin_id", "port", "finding_ord", "load_ord", "severity")


@query("""SELECT 0 AS scan_id, ip, plugin_id, port, finding_ord, CAST(scan_id AS BIGINT) AS load_ord, severity FROM (
  SELECT *, min(scan_id) OVER (PARTITION BY ip, plugin_id) AS first_scan FROM finding) f WHERE f.scan_id = first_scan""")
def mg04_merge_findings_desktop(p):
    return merge.merge_findings(loads(p.findings), loads(p.hosts), "desktop").select("scan_id", "ip", "plugin_id", "port", "finding_ord", "load_ord", "severity")


@query("SELECT 0 AS scan_id, ip, cpe, CAST(min(scan_id) AS BIGINT) AS first_load FROM port_obs WHERE cpe IS NOT NULL GROUP BY ip, cpe")
def mg05_merge_cpes(p):
    return merge.merge_cpes(loads(p.ports.where("cpe IS NOT NULL").select("scan_id", "ip", "cpe")))


TRACES = """SELECT ip, ttl, hop_ip, 1 AS load_ord FROM trace_hop WHERE ttl < 3 UNION ALL SELECT ip, ttl, hop_ip, 2 FROM trace_hop
UNION ALL SELECT ip, ttl, concat(hop_ip, '-late'), 3 FROM trace_hop"""


def trace_loads(p: Projection):
    """Three traces per host: a short one, a full one, and a full one loaded later."""
    one = lambda df, n: df.withColumn("load_ord", F.lit(n).cast("bigint"))
    late = p.trace.withColumn("hop_ip", F.concat("hop_ip", F.lit("-late")))
    return one(p.trace.where("ttl < 3"), 1).unionByName(one(p.trace, 2)).unionByName(one(late, 3))


@query(f"SELECT 0 AS scan_id, ip, ttl, hop_ip FROM ({TRACES}) t WHERE load_ord = 1")
def mg06_merge_trace(p):
    return merge.merge_trace(trace_loads(p)).select("scan_id", "ip", "ttl", "hop_ip")


@query(f"SELECT 0 AS scan_id, ip, ttl, hop_ip FROM ({TRACES}) t WHERE load_ord = 2")
def mg06_merge_trace_desktop(p):
    return merge.merge_trace(trace_loads(p), "desktop").select("scan_id", "ip", "ttl", "hop_ip")


@query("""SELECT ip, bool_or(scan_id % 3 = 0 AND host_id % 2 = 0) AS credentialed_scan,
  min_by(concat('NB', scan_id), scan_id) FILTER ((host_id + scan_id) % 4 <> 0) AS netbios_name FROM host_obs GROUP BY ip""")
def mg07_flags_and_netbios(p):
    host_id = F.regexp_extract("full_name", r"(\d+)$", 1).cast("bigint")
    numbered = p.hosts.join(p.host_dim.select("ip", host_id.alias("host_id")), "ip")
    flagged = numbered.withColumn("credentialed_scan", (F.col("scan_id") % 3 == 0) & (F.col("host_id") % 2 == 0)).withColumn(
        "netbios_name", F.when((F.col("host_id") + F.col("scan_id")) % 4 != 0, F.concat(F.lit("NB"), F.col("scan_id").cast("string")))
    )
    return merge.merge_hosts(loads(flagged.drop("host_id"))).select("ip", "credentialed_scan", "netbios_name")


@query("""SELECT r.scan_id, (SELECT count(*) FROM host_obs i WHERE i.scan_id = r.scan_id AND i.ip NOT IN (SELECT ip FROM host_obs e WHERE e.scan_id < r.scan_id)) AS added,
  (SELECT count(*) FROM host_obs i WHERE i.scan_id = r.scan_id AND i.ip IN (SELECT ip FROM host_obs e WHERE e.scan_id < r.scan_id)) AS updated,
  (SELECT count(DISTINCT ip) FROM host_obs i WHERE i.scan_id <= r.scan_id) AS total, (SELECT count(DISTINCT ip) FROM host_obs i WHERE i.scan_id <= r.scan_id AND i.status = 'up') AS up,
  (SELECT count(DISTINCT ip) FROM host_obs i WHERE i.scan_id <= r.scan_id) - (SELECT count(DISTINCT ip) FROM host_obs i WHERE i.scan_id <= r.scan_id AND i.status = 'up') AS down,
  (SELECT count(*) FROM finding f WHERE f.scan_id = r.scan_id) AS findings
FROM (SELECT max(scan_id) AS scan_id FROM scan_run) r""")
def mg08_import_report(p):
    last = p.runs.agg(F.max("scan_id")).scalar()
    is_last = F.col("scan_id") == last
    existing = merge.merge_hosts(loads(p.hosts.where(F.col("scan_id") < last)))
    return merge.import_report(existing, p.hosts.where(is_last), p.findings.where(is_last)).select(last.alias("scan_id"), "*")


@query("""SELECT CAST(r.scan_id AS INT) AS scan_id, r.source_name AS name, 'nmap' AS type, (SELECT count(*) FROM host_obs h WHERE h.scan_id = r.scan_id) AS hosts, r.started_at AS imported_at FROM scan_run r
UNION ALL SELECT r.scan_id, concat(r.source_name, ' report'), 'nessus', (SELECT count(DISTINCT ip) FROM finding f WHERE f.scan_id = r.scan_id), r.started_at FROM scan_run r""")
def mg09_source_registry(p):
    empty = p.runs.select("scan_id", F.lit("").alias("name"), F.lit("").alias("type"), F.lit(0).cast("bigint").alias("hosts"), F.col("started_at").alias("imported_at")).where(F.lit(False))
    scans = merge.register_sources(empty, p.hosts, p.runs, "nmap")
    reports = p.runs.withColumn("source_name", F.concat("source_name", F.lit(" report")))
    return merge.register_sources(scans, p.findings.select("scan_id", "ip").distinct(), reports, "nessus")


# JN9 is the whole merge: hosts and ports of all scans, then the score of the result.
@query("""SELECT * FROM (WITH hosts AS (SELECT ip, CASE WHEN bool_or(status = 'up') THEN 'up' ELSE min_by(status, scan_id) END AS status FROM host_obs GROUP BY ip),
ports AS (SELECT ip, port, proto, state, svc FROM (SELECT *, row_number() OVER (PARTITION BY ip, port, proto ORDER BY CASE WHEN product IS NULL THEN 1 ELSE 0 END, scan_id) AS rn FROM port_obs) r WHERE rn = 1)
SELECT h.ip, h.status, count(p.port) AS ports, count(p.port) FILTER (p.state = 'open') AS open_ports FROM hosts h LEFT JOIN ports p ON p.ip = h.ip GROUP BY h.ip, h.status) z""")
def jn09_merged_inventory(p):
    ports = merge.merge_ports(loads(p.ports)).groupBy("ip").agg(F.count(F.lit(1)).alias("ports"), F.count_if(F.col("state") == "open").alias("open_ports"))
    zero = F.lit(0).cast("bigint")
    return merge.merge_hosts(loads(p.hosts)).join(ports, "ip", "left").select(
        "ip", "status", F.coalesce("ports", zero).alias("ports"), F.coalesce("open_ports", zero).alias("open_ports")
    )


# ------------------------------------------------------------------ tags
def flat(tag_rows):
    return tag_rows.select("asset_key", F.array_join("labels", ";").alias("labels"), "owner", "notes", "last_ip", F.unix_seconds("last_seen").alias("last_seen"))


@query("""SELECT coalesce(n.asset_key, t.asset_key) AS asset_key, CASE WHEN n.asset_key IS NOT NULL THEN 'p1;monitor' ELSE t.label END AS labels,
  CASE WHEN n.asset_key IS NOT NULL THEN 'blue' ELSE t.owner END AS owner, CASE WHEN n.asset_key IS NULL THEN t.notes END AS notes,
  coalesce(n.ip, t.last_ip) AS last_ip, CASE WHEN n.asset_key IS NOT NULL THEN 1800000000 ELSE 1700000000 + t.host_id END AS last_seen
FROM asset_tag t FULL OUTER JOIN (SELECT ip, CASE WHEN mac IS NULL THEN concat('ip:', ip) ELSE concat('mac:', upper(mac)) END AS asset_key FROM latest_host WHERE status = 'down') n ON n.asset_key = t.asset_key""")
def tg01_upsert(p):
    down = p.latest_hosts.where("status = 'down'")
    return flat(tags.annotate_hosts(p.tags, down, F.array(F.lit("p1"), F.lit("monitor")), F.lit("blue"), F.lit(None).cast("string"), edit_time()))


@query("""SELECT coalesce(n.asset_key, t.asset_key) AS asset_key, CASE WHEN n.asset_key IS NULL OR t.label = 'p1' THEN t.label ELSE concat_ws(';', t.label, 'p1') END AS labels, t.owner, t.notes,
  coalesce(n.ip, t.last_ip) AS last_ip, CASE WHEN n.asset_key IS NOT NULL THEN 1800000000 ELSE 1700000000 + t.host_id END AS last_seen
FROM asset_tag t FULL OUTER JOIN (SELECT ip, CASE WHEN mac IS NULL THEN concat('ip:', ip) ELSE concat('mac:', upper(mac)) END AS asset_key FROM latest_host WHERE status = 'up') n ON n.asset_key = t.asset_key""")
def tg02_add_label(p):
    up = p.latest_hosts.where("status = 'up'")
    once = tags.add_label(p.tags, up, "p1", edit_time())
    return flat(tags.add_label(once, up, "p1", edit_time()))


@query("""SELECT t.asset_key, t.label AS labels, t.owner, t.notes, t.last_ip, 1700000000 + t.host_id AS last_seen FROM asset_tag t
WHERE NOT EXISTS (SELECT 1 FROM latest_host l WHERE l.host_id = t.host_id AND l.status = 'up')""")
def tg03_clear(p):
    return flat(tags.clear_tags(p.tags, p.latest_hosts.where("status = 'up'")))


@query("SELECT t.asset_key, coalesce(l.ip, t.last_ip) AS ip, t.label AS labels, t.owner, t.notes FROM asset_tag t LEFT JOIN latest_host l ON l.host_id = t.host_id")
def tg04_key_terrain_report(p):
    return tags.key_terrain_report(p.tags, p.latest_hosts).withColumn("labels", F.array_join("labels", ";"))


@query("SELECT t.asset_key, t.label, d.category, d.display FROM asset_tag t JOIN tag_label_dim d ON d.label = t.label")
def tg05_label_display(p):
    return tags.label_display(p.tags)


@query("SELECT t.asset_key, coalesce(l.ip, t.last_ip) AS ip, t.label AS labels, t.owner FROM asset_tag t LEFT JOIN latest_host l ON l.host_id = t.host_id ORDER BY asset_key LIMIT 5")
def tk03_first_tagged(p):
    report = tags.key_terrain_report(p.tags, p.latest_hosts).withColumn("labels", F.array_join("labels", ";"))
    return report.select("asset_key", "ip", "labels", "owner").orderBy("asset_key").limit(5)


# ------------------------------------------------------------------ graph
@query("SELECT scan_id, ip, from_node, to_node, ttl FROM topo_edge")
def tp01_edges(p):
    return topology.edges(p.latest_hosts, p.trace)


@query("SELECT * FROM topo_node")
def tp02_nodes(p):
    return topology.nodes(p.latest_hosts, p.trace)


@query("SELECT scan_id, level, count(*) AS nodes FROM topo_node GROUP BY ALL")
def tp03_levels(p):
    return topology.nodes(p.latest_hosts, p.trace).groupBy("scan_id", "level").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT scan_id, ip, ttl, hop_ip, coalesce(hop_host, '') AS hop_host, rtt FROM trace_hop")
def tp04_paths(p):
    return topology.paths(p.trace)


@query("SELECT scan_id, from_node, to_node, count(*) AS traversals, min(ttl) AS min_ttl FROM topo_edge GROUP BY ALL")
def tp05_edge_weights(p):
    return topology.edge_weights(topology.edges(p.latest_hosts, p.trace))


@query("SELECT scan_id, type, count(*) AS nodes FROM topo_node GROUP BY ALL")
def ag16_topology_counts(p):
    return topology.node_counts(topology.nodes(p.latest_hosts, p.trace))


# ------------------------------------------------------------------ scripts and fingerprints
@query("SELECT scan_id, ip, port, script_id FROM script_host")
def ns01_all_scripts(p):
    on_port = p.scripts.where("port IS NOT NULL")
    return scripts.all_scripts(on_port, p.scripts.where("port IS NULL").drop("port")).select(*KEY, "port", "script_id")


@query("SELECT scan_id, ip, port, script_id, 'VULNERABLE' AS output FROM script_host WHERE script_id = 'smb-vuln-ms17-010'")
def ns02_vulnerability_scripts(p):
    return scripts.vulnerability_scripts(p.scripts)


@query("SELECT scan_id, ip, port, script_id, type, detail FROM script_found")
def ns03_script_findings(p):
    return scripts.script_findings(p.scripts).select(*KEY, "port", "script_id", "type", "detail")


def parsed(p, script: str, *columns):
    return scripts.script_findings(p.scripts).where(F.col("script_id") == script).select("ip", *columns)


@query("SELECT ip, concat('commonName=', full_name) AS subject, concat('commonName=ca', host_id % 3) AS issuer, concat('2026-0', 1 + host_id % 9, '-15') AS expires FROM script_found WHERE script_id = 'ssl-cert'")
def ns04_ssl_cert(p):
    return parsed(p, "ssl-cert", "subject", "issuer", "expires")


@query("SELECT ip, concat('page ', host_id % 11) AS title FROM script_found WHERE script_id = 'http-title'")
def ns05_http_title(p):
    return parsed(p, "http-title", "title")


@query("SELECT ip, 'nginx' AS server FROM script_found WHERE script_id = 'http-server-header'")
def ns06_http_server(p):
    return parsed(p, "http-server-header", "server")


@query("SELECT ip, 'Windows Server' AS os, concat('pc', host_id) AS computer, 'corp' AS domain FROM script_found WHERE script_id = 'smb-os-discovery'")
def ns07_smb_os(p):
    return parsed(p, "smb-os-discovery", "os", "computer", "domain")


@query("""SELECT ip, unnest(['2048', '256']) AS bits, unnest(['ssh-rsa', 'ssh-ed25519']) AS algo, unnest(['abcdefghijklmnop...', 'zyxwvutsrqponmlk...']) AS fingerprint
FROM script_found WHERE script_id = 'ssh-hostkey'""")
def ns08_ssh_keys(p):
    return parsed(p, "ssh-hostkey", F.explode("keys").alias("k")).select("ip", "k.*")


@query("SELECT ip, host_id % 20 = 5 AS anonymous, CASE WHEN host_id % 20 = 5 THEN 'high' ELSE 'info' END AS severity FROM script_found WHERE script_id = 'ftp-anon'")
def ns09_ftp_anonymous(p):
    return parsed(p, "ftp-anon", "anonymous", "severity")


@query("SELECT ip, concat('15.', host_id % 4) AS version, concat('SQL', host_id % 2) AS instance FROM script_found WHERE script_id = 'ms-sql-info'")
def ns10_mssql(p):
    return parsed(p, "ms-sql-info", "version", "instance")


@query("SELECT ip, concat('5.7.', host_id % 4) AS version FROM script_found WHERE script_id = 'mysql-info'")
def ns11_mysql(p):
    return parsed(p, "mysql-info", "version")


@query("SELECT type, detail, count(*) AS results, count(DISTINCT ip) AS hosts FROM script_found GROUP BY ALL")
def ns12_findings_rollup(p):
    return scripts.findings_rollup(scripts.script_findings(p.scripts))


@query("""SELECT scan_id, ip, port, concat('commonName=', full_name) AS subject, concat('commonName=ca', host_id % 3) AS issuer, CAST(concat('2026-0', 1 + host_id % 9, '-15') AS DATE) AS expires,
  CAST(CAST(concat('2026-0', 1 + host_id % 9, '-15') AS DATE) - DATE '2026-06-01' AS INT) AS days_left FROM script_found WHERE script_id = 'ssl-cert'""")
def ns12_certificate_expiry(p):
    return scripts.certificate_expiry(scripts.script_findings(p.scripts), "2026-06-01")


FP_SQL = """SELECT scan_id, ip, 'SCAN' AS section, 'V' AS key, '7.95' AS value FROM script_host UNION ALL SELECT scan_id, ip, 'SCAN', 'E', '4' FROM script_host
UNION ALL SELECT scan_id, ip, 'SCAN', 'OT', CAST(20 + host_id % 5 AS VARCHAR) FROM script_host UNION ALL SELECT scan_id, ip, 'SEQ', 'SP', CAST(host_id % 13 AS VARCHAR) FROM script_host
UNION ALL SELECT scan_id, ip, 'SEQ', 'TI', 'Z' FROM script_host"""


@query(FP_SQL)
def fp01_os_fingerprint(p):
    return scripts.os_fingerprint_fields(p.script_hosts)


@query(f"SELECT section, key, value, count(*) AS hosts FROM ({FP_SQL}) f GROUP BY ALL")
def fp01_fingerprint_groups(p):
    return scripts.fingerprint_groups(scripts.os_fingerprint_fields(p.script_hosts))


@query("SELECT scan_id, ip, port, concat('Port', host_id % 1000, '-TCP:V=7.95%r(GetRequest,', host_id, ')') AS response FROM script_host")
def fp02_service_fingerprint(p):
    return scripts.service_fingerprints(p.script_hosts, "service_fingerprint")


# ------------------------------------------------------------------ exports
SHEET_SQL = """SELECT s.scan_id, s.ip AS "IP", coalesce(s.hostname, '') AS "Hostname", coalesce(s.mac, '') AS "MAC", coalesce(s.os_name, '') AS "OS",
  coalesce((SELECT string_agg(CAST(o.port AS VARCHAR), ';' ORDER BY o.port, o.proto) FROM port_obs o WHERE o.scan_id = s.scan_id AND o.ip = s.ip AND o.state = 'open'), '') AS "Open Ports",
  s.risk AS "Risk", coalesce(l.label, '') AS "Labels", coalesce(l.owner, '') AS "Owner", coalesce(l.notes, '') AS "Notes"
FROM scored_web s JOIN host_label l USING (scan_id, ip) WHERE s.status = 'up'"""


@query(SHEET_SQL)
def sk01_host_sheet(p):
    from exposure.plans.fleet_queries import scored

    return exports.host_sheet(scored(p), p.ports, p.tags)


@query("""SELECT scan_id, ip AS "IP", coalesce(hostname, '') AS "Hostname", status AS "Status", coalesce(os_name, '') AS "OS", open_ports AS "OpenPorts", risk AS "RiskScore", cleartext_ports AS "CleartextCount" FROM scored_desktop""")
def sk02_host_sheet_compact(p):
    from exposure.plans.fleet_queries import scored

    return exports.host_sheet_compact(scored(p, "desktop"))


@query("""SELECT 'host' AS kind, h.scan_id, h.ip, h.hostname AS name, CAST(NULL AS INT) AS finding_ord, CAST(NULL AS INT) AS severity,
  coalesce(string_agg(concat(o.port, '/', o.proto, ' ', o.state, ' ', coalesce(o.product, '')), ';' ORDER BY o.port, o.proto), '') AS content
FROM host_obs h LEFT JOIN port_obs o USING (scan_id, ip) GROUP BY h.scan_id, h.ip, h.hostname
UNION ALL SELECT 'finding', scan_id, ip, plugin_name, CAST(finding_ord AS INT), CAST(severity AS INT), concat(plugin_id, ' ', coalesce(CAST(port AS VARCHAR), '')) FROM finding""")
def sk03_nested_json(p):
    text = exports.export_documents(p.inventory.with_tables(trace=None))
    schema = """kind string, scan_id int, ip string, hostname string, plugin_name string, finding_ord int, severity int, plugin_id int, port int,
        ports array<struct<port:int,proto:string,state:string,product:string>>"""
    back = text.select(F.from_json("value", schema).alias("d")).select("d.*")
    line = lambda o: F.concat(o["port"].cast("string"), F.lit("/"), o["proto"], F.lit(" "), o["state"], F.lit(" "), F.coalesce(o["product"], F.lit("")))
    ports = F.coalesce(F.array_join(F.transform("ports", line), ";"), F.lit(""))
    finding = F.concat(F.col("plugin_id").cast("string"), F.lit(" "), F.coalesce(F.col("port").cast("string"), F.lit("")))
    return back.select(
        "kind", "scan_id", "ip", F.coalesce("hostname", "plugin_name").alias("name"), "finding_ord", "severity", F.when(F.col("kind") == "host", ports).otherwise(finding).alias("content"),
    )


@query("SELECT DISTINCT cpe FROM port_obs WHERE cpe IS NOT NULL")
def sk04_cpe_list(p):
    return exports.cpe_list(p.ports)


@query("""SELECT t.asset_key AS key, coalesce(l.ip, t.last_ip, '') AS ip, coalesce(l.mac, CASE WHEN t.asset_key LIKE 'mac:%' THEN substr(t.asset_key, 5) END, '') AS mac, coalesce(l.hostname, '') AS hostname,
  t.label AS labels, coalesce(t.owner, '') AS owner, coalesce(t.notes, '') AS notes FROM asset_tag t LEFT JOIN latest_host l ON l.host_id = t.host_id""")
def sk05_tag_sheet(p):
    return exports.tag_sheet(p.tags, p.latest_hosts).withColumn("labels", F.array_join("labels", ";")).drop("last_seen")


@query("SELECT cpe, CAST(ord AS BIGINT) AS ord, cve, cvss, CAST(NULL AS VARCHAR) AS severity, descr FROM vuln_db WHERE cve IS NOT NULL")
def sk06_vuln_documents(p):
    lines = exports.vuln_documents(p.vuln_db)
    text = lines.select(F.to_json(F.struct(*[F.col(c) for c in lines.columns])).alias("value"))
    return text.select(F.from_json("value", schemas.VULN_DB_LINE).alias("d")).select("d.*").withColumnRenamed("desc", "descr")
