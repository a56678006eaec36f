"""Queries over the whole fleet: scalars, filters, search, aggregations, groups, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure.functions import columns as C
from exposure.operators import filters, groups, postings, risk, rollups, scripts as script_ops, search, topk, vulns
from exposure.plans.projection import Projection
from exposure.plans.registry import query

KEY = C.HOST_KEY
HOST_SQL = "scan_id, ip, mac, hostname, status, os_name, os_accuracy"


def scored(p: Projection, profile: str = "web"):
    return risk.score_hosts(p.hosts, p.ports, p.findings, profile)


# ------------------------------------------------------------------ scalars
@query(f"SELECT scan_id, ip, asset_key FROM host_label")
def pr04_asset_key(p):
    return p.hosts.select("scan_id", "ip", C.asset_key(F.col("mac"), F.col("ip")).alias("asset_key"))


@query("""SELECT finding_ord, severity, CASE severity WHEN 0 THEN 'Info' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' WHEN 4 THEN 'Critical' END AS severity_label
FROM report_item""")
def sf01_severity_label(p):
    return p.report_items.select("finding_ord", "severity", C.severity_label(F.col("severity")).alias("severity_label"))


@query("""SELECT scan_id, ip,
  CASE WHEN regexp_matches(o, 'windows|microsoft') THEN 'windows' WHEN regexp_matches(o, 'linux|ubuntu|debian|centos|redhat') THEN 'linux'
    WHEN regexp_matches(o, 'cisco|juniper|fortinet') THEN 'network' ELSE 'unknown' END AS web_class,
  CASE WHEN regexp_matches(o, 'windows|microsoft') THEN 'windows' WHEN regexp_matches(o, 'linux|ubuntu|debian|centos|fedora|redhat|rhel|suse') THEN 'linux'
    WHEN regexp_matches(o, 'cisco|juniper|arista|palo alto|fortinet|mikrotik|vyos|router|switch') THEN 'network' ELSE 'unknown' END AS desktop_class
FROM (SELECT *, lower(coalesce(os_name, '')) AS o FROM host_obs) h""")
def sf02_os_class(p):
    return p.hosts.select("scan_id", "ip", C.os_class(F.col("os_name")).alias("web_class"), C.os_class(F.col("os_name"), "desktop").alias("desktop_class"))


@query("SELECT scan_id, ip, port, proto, CAST(weight AS INT) AS risk_weight FROM port_facts_web")
def sf03_port_risk_weight(p):
    return risk.with_port_risk(p.ports).select(*KEY, "port", "proto", "risk_weight")


@query("SELECT scan_id, ip, port, proto, CAST(weight AS INT) AS risk_weight, CAST(score AS INT) AS score_weight FROM port_facts_desktop")
def sf03_port_risk_weight_desktop(p):
    return risk.with_port_risk(p.ports, "desktop").select(*KEY, "port", "proto", "risk_weight", "score_weight")


@query("SELECT scan_id, ip, port, proto, cleartext_name IS NOT NULL AS is_cleartext FROM port_facts_web")
def sf04_is_cleartext(p):
    return risk.with_port_risk(p.ports).select(*KEY, "port", "proto", "is_cleartext")


@query("""SELECT w.scan_id, w.ip, w.port, w.proto, w.cleartext_name AS web_name, d.cleartext_name AS desktop_name
FROM port_facts_web w JOIN port_facts_desktop d USING (scan_id, ip, port, proto)""")
def sf05_cleartext_name(p):
    web = risk.with_port_risk(p.ports).withColumnRenamed("cleartext_name", "web_name").drop("risk_weight", "is_cleartext", "score_weight")
    return risk.with_port_risk(web, "desktop").select(*KEY, "port", "proto", "web_name", F.col("cleartext_name").alias("desktop_name"))


@query("SELECT scan_id, ip, risk, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level FROM scored_web")
def sf06_risk_level(p):
    return scored(p).select(*KEY, "risk", C.risk_level(F.col("risk")).alias("level"))


@query("SELECT cpe, cve, cvss, CASE WHEN cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS cvss_class FROM vuln_db")
def sf07_cvss_class(p):
    return p.vuln_db.select("cpe", "cve", "cvss", C.cvss_class(F.col("cvss")).alias("cvss_class"))


@query("""SELECT ip, concat(a, '.0.0.0/8') AS net8, concat(a, '.', b, '.0.0/16') AS net16, concat(a, '.', b, '.', c // 16 * 16, '.0/20') AS net20,
  concat(a, '.', b, '.', c, '.0/24') AS net24, concat(a, '.', b, '.', c, '.', d // 16 * 16, '/28') AS net28, 'other' AS not_ip
FROM (SELECT ip, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b, CAST(split_part(ip, '.', 3) AS INT) AS c,
  CAST(split_part(ip, '.', 4) AS INT) AS d FROM host_dim) x""")
def sf08_subnet_key(p):
    masks = [C.subnet_key(F.col("ip"), m).alias(f"net{m}") for m in C.SUBNET_MASKS]
    return p.host_dim.select("ip", *masks, C.subnet_key(F.col("full_name")).alias("not_ip"))


@query("""SELECT scan_id, concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', CAST(split_part(ip, '.', 3) AS INT) // 16 * 16, '.0/20') AS group_key,
  20 AS mask, CAST(4094 AS BIGINT) AS subnet_hosts, CAST(16 AS DOUBLE) AS subnets_in_16, count(*) AS hosts FROM host_obs WHERE status = 'up' GROUP BY ALL""")
def sf09_subnet_facts(p):
    return groups.by_subnet(p.hosts, 20).drop("group_label")


DOMINANT_SQL = """SELECT h.scan_id, h.ip, coalesce(g.service_group, 'other') AS service_group FROM host_obs h LEFT JOIN (
  SELECT scan_id, ip, service_group, row_number() OVER (PARTITION BY scan_id, ip ORDER BY n DESC, group_order) AS rn FROM (
    SELECT scan_id, ip, service_group, group_order, count(*) AS n FROM port_obs JOIN service_group_dim USING (port) WHERE state = 'open' GROUP BY ALL) c) g
  ON g.scan_id = h.scan_id AND g.ip = h.ip AND g.rn = 1"""


@query(DOMINANT_SQL)
def sf10_dominant_service(p):
    return groups.dominant_service(p.hosts, p.ports).select(*KEY, "service_group")


@query("""SELECT cpe, cpe AS base, replace(cpe, 'cpe:/', 'cpe:2.3:') AS cpe23,
  array_to_string(list_slice(string_split(replace(cpe, 'cpe:/', 'cpe:2.3:'), ':'), 1, 5), ':') AS product, split_part(cpe, ':', 5) AS version
FROM port_obs WHERE cpe IS NOT NULL GROUP BY ALL
UNION ALL SELECT cpe, array_to_string(list_slice(string_split(cpe, ':'), 1, 5), ':'), cpe, array_to_string(list_slice(string_split(cpe, ':'), 1, 5), ':'), split_part(cpe, ':', 6)
FROM vuln_db GROUP BY ALL""")
def sf11_cpe_forms(p):
    both = p.ports.where(F.col("cpe").isNotNull()).select("cpe").distinct().unionByName(p.vuln_db.select("cpe").distinct())
    cpe23 = C.cpe_23(F.col("cpe"))
    return both.select("cpe", C.cpe_base(F.col("cpe")).alias("base"), cpe23.alias("cpe23"), C.cpe_base(cpe23).alias("product"), C.cpe_version(cpe23).alias("version"))


@query("""SELECT doc_id, md5(CASE WHEN contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) THEN concat('"', replace(text, '"', '""'), '"') ELSE text END) AS field_md5,
  md5(concat('"', replace(text, '"', '""'), '"')) AS quoted_md5 FROM documents""")
def sf12_csv_field(p):
    return p.table("documents").select(
        "doc_id", F.md5(C.csv_field(F.col("text"))).alias("field_md5"), F.md5(C.csv_field(F.col("text"), quote_all=True)).alias("quoted_md5")
    )


# ------------------------------------------------------------------ filters
@query("SELECT * FROM port_obs WHERE state = 'open'")
def fl01_open_ports(p):
    return filters.open_ports(p.ports)


@query("SELECT * FROM port_obs WHERE state = 'filtered'")
def fl01_filtered_ports(p):
    return filters.filtered_ports(p.ports)


@query(f"SELECT {HOST_SQL} FROM host_obs WHERE status = 'up'")
def fl02_up_hosts(p):
    return filters.up_hosts(p.hosts)


@query(f"SELECT {HOST_SQL} FROM host_label WHERE status = 'up' AND label IN ('ckt', 'mission-critical', 'mission-essential', 'crown')")
def fl03_key_terrain(p):
    return filters.entity_filter(p.inventory, "ckt")


@query(f"SELECT {HOST_SQL} FROM host_label WHERE status = 'up' AND (label IS NOT NULL OR owner IS NOT NULL OR notes IS NOT NULL)")
def fl04_tagged(p):
    return filters.entity_filter(p.inventory, "tagged")


@query(f"SELECT {HOST_SQL} FROM host_obs h WHERE status = 'up' AND EXISTS (SELECT 1 FROM port_obs o JOIN admin_dim a USING (port) WHERE o.scan_id = h.scan_id AND o.ip = h.ip AND o.state = 'open')")
def fl05_admin(p):
    return filters.entity_filter(p.inventory, "admin")


@query(f"SELECT {HOST_SQL} FROM scored_web WHERE status = 'up' AND cleartext_ports > 0")
def fl06_cleartext(p):
    return filters.entity_filter(p.inventory, "cleartext")


@query(f"SELECT {HOST_SQL} FROM scored_web WHERE status = 'up' AND risk >= 50")
def fl07_high_risk(p):
    return filters.entity_filter(p.inventory, "risk")


@query(f"SELECT {HOST_SQL} FROM host_label WHERE status = 'up' AND label = 'production'")
def fl08_production(p):
    return filters.entity_filter(p.inventory, "production")


def _port_search_sql(test: str, opened: bool = True) -> str:
    state = "o.state = 'open' AND " if opened else ""
    return f"SELECT {HOST_SQL} FROM host_obs h WHERE EXISTS (SELECT 1 FROM port_obs o WHERE o.scan_id = h.scan_id AND o.ip = h.ip AND {state}{test})"


@query(_port_search_sql("contains(CAST(o.port AS VARCHAR), '43')"))
def fl09_search_port_text(p):
    return search.search(p.inventory, [("port", "43")])


@query(_port_search_sql("o.port BETWEEN 80 AND 443"))
def fl09_search_port_range(p):
    return search.search(p.inventory, [("port", "80-443")])


@query(_port_search_sql("lower(o.svc) LIKE 'http%'"))
def fl09_search_service(p):
    return search.search(p.inventory, [("svc", "HTTP*")])


@query(_port_search_sql("contains(o.product, 'prod1')", opened=False))
def fl10_search_product(p):
    return search.search(p.inventory, [("product", "prod1")])


@query(f"SELECT {HOST_SQL} FROM host_obs WHERE contains(lower(os_name), 'linux') AND ip LIKE '10.1%' AND contains(lower(hostname), '1') AND contains(mac, 'cc:0')")
def fl11_search_host_fields(p):
    return search.search(p.inventory, [("os", "Linux"), ("ip", "10.1*"), ("host", "1"), ("mac", "CC:0")])


@query(f"SELECT {HOST_SQL} FROM host_label WHERE contains(label, 'c') AND owner LIKE 's%c'")
def fl12_search_tag_owner(p):
    return search.search(p.inventory, [("tag", "c"), ("owner", "S*c")])


@query(f"""SELECT {HOST_SQL} FROM host_obs h WHERE EXISTS (SELECT 1 FROM cve_match c WHERE c.scan_id = h.scan_id AND c.ip = h.ip AND c.cve LIKE 'CVE-2004-%')
  OR EXISTS (SELECT 1 FROM finding f WHERE f.scan_id = h.scan_id AND f.ip = h.ip AND f.cve LIKE 'CVE-2004-%')""")
def fl13_search_cve(p):
    return search.search(p.inventory, [("cve", "cve-2004-*")])


@query(f"SELECT {HOST_SQL} FROM host_obs h WHERE EXISTS (SELECT 1 FROM finding f WHERE f.scan_id = h.scan_id AND f.ip = h.ip AND contains(f.cve, '2024-10'))")
def fl13_search_cve_findings(p):
    return search.by_cve(p.hosts, p.inventory, "2024-10", source="findings")


@query(f"""SELECT {HOST_SQL} FROM host_obs h WHERE EXISTS (SELECT 1 FROM port_obs o JOIN admin_dim a USING (port) WHERE o.scan_id = h.scan_id AND o.ip = h.ip AND o.state = 'open'
  AND (contains(lower(a.admin_name), 'container') OR contains(lower(a.admin_category), 'container')))""")
def fl14_search_admin(p):
    return search.search(p.inventory, [("admin", "container")])


@query(f"SELECT {HOST_SQL} FROM scored_web WHERE risk >= 20 AND risk < 40 AND risk > 22")
def fl15_search_risk(p):
    return search.search(p.inventory, [("risk", "20"), ("risk", "<40"), ("risk", ">22")])


@query(f"""SELECT {HOST_SQL} FROM (SELECT h.*, lower(concat_ws(' ', h.ip, coalesce(h.hostname, ''), coalesce(t.txt, ''), coalesce(h.os_name, ''))) AS search_text FROM host_obs h
  LEFT JOIN (SELECT scan_id, ip, string_agg(concat_ws(' ', CAST(port AS VARCHAR), coalesce(svc, ''), coalesce(product, '')), ' ' ORDER BY port, proto) AS txt
    FROM port_obs WHERE state = 'open' GROUP BY scan_id, ip) t USING (scan_id, ip)) s WHERE contains(search_text, '22 ssh prod0') OR contains(search_text, 'no such text')""")
def fl16_search_text(p):
    return search.search(p.inventory, [("text", "22 SSH prod0")])


@query(f"""SELECT {HOST_SQL} FROM host_obs h WHERE contains(lower(os_name), 'windows')
  AND EXISTS (SELECT 1 FROM port_obs o WHERE o.scan_id = h.scan_id AND o.ip = h.ip AND o.state = 'open' AND o.port BETWEEN 1 AND 1024)
  AND EXISTS (SELECT 1 FROM port_obs o WHERE o.scan_id = h.scan_id AND o.ip = h.ip AND contains(o.product, 'prod'))""")
def fl17_search_conjunction(p):
    return search.search(p.inventory, [("os", "windows"), ("port", "1-1024"), ("product", "prod")])


@query(f"SELECT {HOST_SQL} FROM host_obs")
def fl17_search_no_terms(p):
    return search.search(p.inventory, [])


@query("""SELECT scan_id, count(*) FILTER (cleartext_ports > 0 AND contains(lower(os_name), 'linux')) AS visible, count(*) AS total
FROM scored_web WHERE status = 'up' GROUP BY scan_id""")
def fl18_visible_counts(p):
    return search.visibility(p.inventory, [("os", "linux")], "cleartext")


@query(f"""SELECT {HOST_SQL} FROM host_obs h WHERE contains(ip, '23') OR contains(coalesce(hostname, ''), '23') OR contains(lower(coalesce(os_name, '')), '23')
  OR EXISTS (SELECT 1 FROM port_obs o WHERE o.scan_id = h.scan_id AND o.ip = h.ip AND (contains(CAST(o.port AS VARCHAR), '23') OR contains(lower(coalesce(o.svc, '')), '23')))""")
def fl19_quick_search(p):
    return search.quick_search(p.inventory, "23")


@query("SELECT plugin_id, severity, count(*) AS entries FROM finding WHERE severity = 4 GROUP BY ALL")
def fl20_rollup_of_severity(p):
    return filters.findings_of_severity(vulns.vulnerability_rollup(p.findings), 4).select("plugin_id", "severity", "entries")


# ------------------------------------------------------------------ aggregations
@query("SELECT scan_id, ip, risk FROM scored_web")
def ag01_host_risk(p):
    return scored(p).select(*KEY, "risk")


@query("SELECT scan_id, ip, risk FROM scored_desktop")
def ag01_host_risk_desktop(p):
    return scored(p, "desktop").select(*KEY, "risk")


@query("SELECT scan_id, ip, status, risk, open_ports, cleartext_ports FROM scored_web")
def ag02_scored_hosts(p):
    return scored(p).select(*KEY, "status", "risk", "open_ports", "cleartext_ports")


@query("SELECT scan_id, ip, status, risk, open_ports, cleartext_ports FROM scored_desktop")
def ag02_scored_hosts_desktop(p):
    return scored(p, "desktop").select(*KEY, "status", "risk", "open_ports", "cleartext_ports")


@query("""SELECT scan_id, count(*) AS hosts, count(*) FILTER (status = 'up') AS hosts_up, CAST(sum(open_ports) AS BIGINT) AS open_ports,
  CAST(coalesce(sum(cleartext_ports) FILTER (status = 'up'), 0) AS BIGINT) AS cleartext_services,
  CAST(coalesce(round(avg(risk) FILTER (status = 'up' AND risk > 0)), 0) AS INT) AS average_risk FROM scored_web GROUP BY scan_id""")
def ag03_dashboard(p):
    return risk.dashboard_totals(scored(p))


@query("""SELECT scan_id, count(*) AS hosts, count(*) FILTER (status = 'up') AS hosts_up, CAST(sum(open_ports) AS BIGINT) AS open_ports,
  CAST(sum(cleartext_ports) AS BIGINT) AS cleartext_services, CAST(sum(risk) // count(*) FILTER (status = 'up') AS INT) AS average_risk FROM scored_desktop GROUP BY scan_id""")
def ag03_dashboard_desktop(p):
    return risk.dashboard_totals(scored(p, "desktop"), "desktop")


OS_SQL = """CASE WHEN regexp_matches(lower(os_name), 'windows|microsoft') THEN 'windows' WHEN regexp_matches(lower(os_name), 'linux|ubuntu|debian|centos|redhat') THEN 'linux'
  WHEN regexp_matches(lower(os_name), 'cisco|juniper|fortinet') THEN 'network' ELSE 'unknown' END"""


@query(f"SELECT scan_id, {OS_SQL} AS os_class, count(*) AS hosts FROM host_obs WHERE status = 'up' GROUP BY ALL")
def ag04_os_distribution(p):
    return groups.os_distribution(p.hosts)


@query(f"SELECT scan_id, concat(upper(substr({OS_SQL}, 1, 1)), substr({OS_SQL}, 2)) AS os_class, count(*) AS hosts FROM host_obs GROUP BY ALL")
def ag04_os_distribution_desktop(p):
    return groups.os_distribution(p.hosts, "desktop")


@query("SELECT severity_label, count(*) AS findings FROM finding GROUP BY severity_label")
def ag05_severity_counts(p):
    return vulns.severity_counts(p.findings)


@query("""SELECT count(*) FILTER (severity = 4) AS critical, count(*) FILTER (severity = 3) AS high, count(*) FILTER (severity = 2) AS medium, count(*) FILTER (severity = 1) AS low,
  count(*) FILTER (exploit_available) AS exploitable, count(*) AS findings, count(DISTINCT ip) AS hosts_affected FROM finding""")
def ag06_findings_summary(p):
    return vulns.severity_summary(p.findings)


ROLLUP_SQL = "SELECT plugin_id, plugin_name, severity, severity_label, cvss3, exploit_available, count(*) AS entries, count(DISTINCT ip) AS hosts, min(cve) AS cve FROM finding GROUP BY ALL"


@query(f"SELECT plugin_id, plugin_name, severity, severity_label, cvss3, entries FROM ({ROLLUP_SQL}) r ORDER BY severity DESC, entries DESC, plugin_id LIMIT 5")
def ag07_common_vulnerabilities(p):
    return vulns.common_vulnerabilities(vulns.vulnerability_rollup(p.findings))


@query(ROLLUP_SQL)
def ag08_vulnerability_rollup(p):
    return vulns.vulnerability_rollup(p.findings).withColumn("cve", F.array_join("cves", ",")).drop("cves", "cvss")


@query("SELECT f.plugin_id, f.scan_id, f.ip, h.hostname, f.port, count(*) AS entries FROM finding f LEFT JOIN host_obs h USING (scan_id, ip) GROUP BY ALL")
def ag08_affected_hosts(p):
    return vulns.affected_hosts(p.findings, p.hosts)


@query("""SELECT count(DISTINCT plugin_id) AS plugins, count(DISTINCT plugin_id) FILTER (severity = 4) AS critical, count(DISTINCT plugin_id) FILTER (severity = 3) AS high,
  count(DISTINCT plugin_id) FILTER (severity = 2) AS medium, count(DISTINCT plugin_id) FILTER (severity = 1) AS low, count(DISTINCT ip) AS hosts FROM finding""")
def ag09_rollup_summary(p):
    return vulns.rollup_summary(p.findings)


@query("""SELECT e.scan_id, e.port, coalesce(min_by(e.svc, e.ip || ' ' || e.proto) FILTER (e.rn = 1), 'unknown') AS service, min_by(e.product, e.ip) FILTER (e.rn = 1) AS product,
  count(*) AS instances, count(DISTINCT e.ip) AS hosts, a.port IS NOT NULL AS is_admin, max(e.cleartext_name) FILTER (e.rn = 1) IS NOT NULL AS is_cleartext,
  max(e.cleartext_name) FILTER (e.rn = 1) AS cleartext_name,
  CASE WHEN a.admin_severity = 'critical' THEN 'critical' WHEN a.port IS NOT NULL THEN 'warning' WHEN max(e.cleartext_name) FILTER (e.rn = 1) IS NOT NULL THEN 'cleartext' ELSE '' END AS card_severity
FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, port ORDER BY ip, proto) AS rn FROM exposed_port) e LEFT JOIN admin_dim a ON a.port = e.port
GROUP BY e.scan_id, e.port, a.port, a.admin_severity""")
def ag10_port_rollup(p):
    return rollups.port_rollup(p.hosts, p.ports)


@query("""SELECT s.scan_id, s.service_key, f.svc AS service, s.ports, s.hosts, s.products,
  concat(array_to_string(list_slice(s.port_set, 1, 5), ', '), CASE WHEN s.ports > 5 THEN '...' ELSE '' END) AS port_list,
  CASE WHEN s.any_critical THEN 'critical' WHEN s.any_admin THEN 'warning' WHEN s.any_clear OR c.svc_cleartext IS NOT NULL THEN 'cleartext' ELSE '' END AS card_severity
FROM (SELECT e.scan_id, lower(e.svc) AS service_key, count(DISTINCT e.port) AS ports, count(DISTINCT e.ip) AS hosts, count(DISTINCT e.product) AS products,
    list_sort(list(DISTINCT e.port)) AS port_set, coalesce(bool_or(a.admin_severity = 'critical'), false) AS any_critical, bool_or(a.port IS NOT NULL) AS any_admin,
    bool_or(d.port_cleartext IS NOT NULL) AS any_clear
  FROM exposed_port e LEFT JOIN admin_dim a ON a.port = e.port LEFT JOIN port_dim_web d ON d.port = e.port WHERE e.svc IS NOT NULL GROUP BY e.scan_id, lower(e.svc)) s
JOIN (SELECT scan_id, lower(svc) AS service_key, svc, row_number() OVER (PARTITION BY scan_id, lower(svc) ORDER BY ip, port, proto) AS rn FROM exposed_port WHERE svc IS NOT NULL) f
  ON f.scan_id = s.scan_id AND f.service_key = s.service_key AND f.rn = 1
LEFT JOIN service_dim_web c ON c.svc_key = f.svc""")
def ag11_service_rollup(p):
    return rollups.service_rollup(p.hosts, p.ports)


@query("SELECT scan_id, cleartext_name, count(*) AS instances, count(DISTINCT ip) AS hosts FROM exposed_port WHERE cleartext_name IS NOT NULL GROUP BY ALL")
def ag12_cleartext_rollup(p):
    return rollups.cleartext_rollup(p.hosts, p.ports)


@query("SELECT scan_id, count(*) AS instances, count(DISTINCT ip) AS hosts FROM exposed_port WHERE cleartext_name IS NOT NULL GROUP BY ALL")
def ag12_cleartext_totals(p):
    return rollups.cleartext_totals(p.hosts, p.ports)


@query("""SELECT s.scan_id, s.ip, s.risk, s.open_ports, s.filtered_ports, s.cleartext_ports, s.findings, s.critical_findings, s.high_findings, s.medium_findings, s.low_findings,
  coalesce(a.admin_ports, 0) AS admin_ports, coalesce(a.critical_admin_ports, 0) AS critical_admin_ports, coalesce(c.cves, 0) AS cves, coalesce(v.n, 0) AS script_vulns
FROM scored_web s
LEFT JOIN (SELECT scan_id, ip, count(*) AS admin_ports, count(*) FILTER (admin_rank <= 1) AS critical_admin_ports FROM port_obs JOIN admin_dim USING (port) WHERE state = 'open' GROUP BY ALL) a USING (scan_id, ip)
LEFT JOIN (SELECT scan_id, ip, count(*) AS cves FROM cve_match GROUP BY ALL) c USING (scan_id, ip)
LEFT JOIN (SELECT ip, count(*) AS n FROM script_host WHERE script_id = 'smb-vuln-ms17-010' GROUP BY ip) v USING (ip)""")
def ag13_host_counts(p):
    scripts = p.scripts.drop("scan_id").join(p.hosts.select("scan_id", "ip"), "ip")
    out = rollups.host_counts(p.inventory.with_tables(scripts=scripts))
    return out.drop("mac", "hostname", "status", "os_name", "os_accuracy", "top_port")


@query("SELECT count(DISTINCT cpe) AS cpes, count(*) AS mappings, count(DISTINCT cve) AS unique_cves FROM vuln_db")
def ag14_vuln_db_stats(p):
    return vulns.vuln_db_stats(p.vuln_db)


POSTING_SQL = """SELECT DISTINCT q.scan_id, q.kind, q.key, q.ip FROM (
  SELECT scan_id, 'port' AS kind, CAST(port AS VARCHAR) AS key, ip FROM port_obs WHERE state = 'open'
  UNION ALL SELECT scan_id, 'service', lower(svc), ip FROM port_obs WHERE state = 'open'
  UNION ALL SELECT scan_id, 'product', lower(product), ip FROM port_obs WHERE state = 'open'
  UNION ALL SELECT scan_id, 'os', w, ip FROM (SELECT scan_id, ip, unnest(string_split(lower(os_name), ' ')) AS w FROM host_obs) x WHERE length(w) > 2
  UNION ALL SELECT scan_id, 'tag', label, ip FROM host_label
  UNION ALL SELECT scan_id, 'cve', lower(cve), ip FROM cve_match
  UNION ALL SELECT scan_id, 'cve', lower(cve), ip FROM finding
  UNION ALL SELECT scan_id, 'product', lower(plugin_name), ip FROM finding) q JOIN host_obs h USING (scan_id, ip) WHERE q.key IS NOT NULL AND h.status = 'up'"""


@query(POSTING_SQL)
def ag15_postings(p):
    return postings.postings(p.inventory)


@query(f"SELECT kind, key, count(DISTINCT ip) AS hosts FROM ({POSTING_SQL}) z GROUP BY kind, key")
def ag15_posting_counts(p):
    return postings.key_counts(p.inventory)


# ------------------------------------------------------------------ groups
GROUP_LABEL_OS = "CASE group_key WHEN 'windows' THEN 'Windows' WHEN 'linux' THEN 'Linux' WHEN 'network' THEN 'Network Devices' ELSE 'Unknown OS' END AS group_label"


@query(f"SELECT *, {GROUP_LABEL_OS} FROM (SELECT scan_id, {OS_SQL} AS group_key, count(*) AS hosts FROM host_obs WHERE status = 'up' GROUP BY ALL) g")
def gr01_by_os(p):
    return groups.largest_first(groups.by_os(p.hosts))


@query("""SELECT scan_id, regexp_replace(ip, '[0-9]+$', '0/24') AS group_key, regexp_replace(ip, '[0-9]+$', '0/24') AS group_label, count(*) AS hosts,
  24 AS mask, CAST(254 AS BIGINT) AS subnet_hosts, CAST(256 AS DOUBLE) AS subnets_in_16 FROM host_obs WHERE status = 'up' GROUP BY ALL""")
def gr02_by_subnet(p):
    return groups.largest_first(groups.by_subnet(p.hosts))


@query(f"""SELECT d.scan_id, d.service_group AS group_key, count(*) AS hosts, CASE d.service_group WHEN 'web' THEN 'Web Servers' WHEN 'database' THEN 'Databases' WHEN 'mail' THEN 'Mail Servers'
  WHEN 'file' THEN 'File Sharing' WHEN 'remote' THEN 'Remote Access' WHEN 'directory' THEN 'Directory Services' ELSE 'Other Services' END AS group_label
FROM ({DOMINANT_SQL}) d JOIN host_obs h USING (scan_id, ip) WHERE h.status = 'up' GROUP BY d.scan_id, d.service_group""")
def gr03_by_service(p):
    return groups.largest_first(groups.by_service(p.hosts, p.ports))


@query("""SELECT *, CASE group_key WHEN 'critical' THEN 'Critical Risk (70+)' WHEN 'high' THEN 'High Risk (50-69)' WHEN 'medium' THEN 'Medium Risk (25-49)' ELSE 'Low Risk (0-24)' END AS group_label
FROM (SELECT scan_id, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS group_key, count(*) AS hosts
  FROM scored_web WHERE status = 'up' GROUP BY ALL) g""")
def gr04_by_risk(p):
    return groups.largest_first(groups.by_risk(scored(p)))


# ------------------------------------------------------------------ previews
@query("""SELECT scan_id, ip, hostname, risk, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN critical_findings > 0 THEN concat(critical_findings, ' critical vulns') WHEN high_findings > 0 THEN concat(high_findings, ' high vulns')
    WHEN top_port IS NOT NULL THEN concat('Port ', top_port) ELSE 'Multiple factors' END AS reason
FROM (SELECT s.*, (SELECT port FROM port_facts_web f WHERE f.scan_id = s.scan_id AND f.ip = s.ip AND f.state = 'open' AND f.score > 0 ORDER BY f.score DESC, f.port LIMIT 1) AS top_port
  FROM (SELECT * FROM scored_web WHERE status = 'up' AND risk > 0 ORDER BY risk DESC, scan_id, ip LIMIT 5) s) t""")
def tk01_top_risky_hosts(p):
    return risk.top_risky_hosts(scored(p))


@query("""SELECT scan_id, ip, hostname, risk, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 50 THEN 'high' WHEN risk >= 25 THEN 'medium' ELSE 'low' END AS level,
  CASE WHEN critical_findings > 0 THEN concat(critical_findings, ' critical vulns') WHEN high_findings > 0 THEN concat(high_findings, ' high vulns')
    WHEN top_port IS NOT NULL THEN concat('Port ', top_port) ELSE 'Multiple factors' END AS reason
FROM (SELECT s.*, coalesce(n.critical_findings, 0) AS critical_findings, coalesce(n.high_findings, 0) AS high_findings,
    (SELECT port FROM port_facts_desktop f WHERE f.scan_id = s.scan_id AND f.ip = s.ip AND f.state = 'open' AND f.score > 0 ORDER BY f.score DESC, f.port LIMIT 1) AS top_port
  FROM (SELECT * FROM scored_desktop ORDER BY risk DESC, scan_id, ip LIMIT 5) s LEFT JOIN finding_count n USING (scan_id, ip)) t""")
def tk01_top_risky_hosts_desktop(p):
    return risk.top_risky_hosts(scored(p, "desktop"), profile="desktop")


@query("""SELECT s.scan_id, s.ip, s.risk, s.critical_findings, s.high_findings,
  CASE WHEN critical_findings > 0 THEN concat(critical_findings, ' critical vulns') WHEN high_findings > 0 THEN concat(high_findings, ' high vulns')
    WHEN t.port IS NOT NULL THEN concat('Port ', t.port) ELSE 'Multiple factors' END AS reason
FROM scored_web s LEFT JOIN (SELECT scan_id, ip, port, row_number() OVER (PARTITION BY scan_id, ip ORDER BY score DESC, port) AS rn FROM port_facts_web WHERE state = 'open' AND score > 0) t
  ON t.scan_id = s.scan_id AND t.ip = s.ip AND t.rn = 1""")
def tk01_leading_reasons(p):
    return risk.leading_reason(scored(p)).select(*KEY, "risk", "critical_findings", "high_findings", "reason")


@query("""SELECT scan_id, ip, finding_ord, plugin_name, severity, CAST(rn AS INT) AS rank, greatest(n - 3, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, ip ORDER BY severity DESC, cvss3 DESC, finding_ord) AS rn, count(*) OVER (PARTITION BY scan_id, ip) AS n FROM finding) f WHERE rn <= 3""")
def tk02_findings_preview(p):
    order = [F.desc("severity"), F.desc(F.coalesce("cvss3", "cvss", F.lit(0.0))), F.asc("finding_ord")]
    return topk.preview(p.findings, KEY, order, 3).select(*KEY, "finding_ord", "plugin_name", "severity", "rank", "more")


@query("""SELECT scan_id, ip, port, proto, admin_name, admin_severity, CAST(rn AS INT) AS rank, greatest(n - 4, 0) AS more FROM (
  SELECT o.*, a.admin_name, a.admin_severity, row_number() OVER (PARTITION BY scan_id, ip ORDER BY admin_rank, port, proto) AS rn, count(*) OVER (PARTITION BY scan_id, ip) AS n
  FROM port_obs o JOIN admin_dim a USING (port) WHERE o.state = 'open') f WHERE rn <= 4""")
def tk02_admin_preview(p):
    out = topk.preview(rollups.admin_ports(p.ports), KEY, [F.asc("admin_rank"), F.asc("port"), F.asc("proto")], 4)
    return out.select(*KEY, "port", "proto", "admin_name", "admin_severity", "rank", "more")


@query("""SELECT scan_id, ip, cve, cvss, CAST(rn AS INT) AS rank, greatest(n - 3, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, ip ORDER BY cvss DESC, cve) AS rn, count(*) OVER (PARTITION BY scan_id, ip) AS n FROM cve_match) f WHERE rn <= 3""")
def tk02_cve_preview(p):
    return vulns.top_cves(p.ports, p.vuln_db, 3).select(*KEY, "cve", "cvss", "rank", "more")


@query("""SELECT scan_id, port, ip, CAST(rn AS INT) AS rank, greatest(n - 3, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, port ORDER BY ip, proto) AS rn, count(*) OVER (PARTITION BY scan_id, port) AS n FROM exposed_port) f WHERE rn <= 3""")
def tk02_port_hosts_preview(p):
    exposed = rollups.exposed_ports(p.hosts, p.ports)
    return topk.preview(exposed, ["scan_id", "port"], [F.asc("ip"), F.asc("proto")], 3).select("scan_id", "port", "ip", "rank", "more")


@query("""SELECT scan_id, ip, script_id, type, detail, CAST(rn AS INT) AS rank, greatest(n - 4, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, ip ORDER BY port, script_id) AS rn, count(*) OVER (PARTITION BY scan_id, ip) AS n FROM script_found) f WHERE rn <= 4""")
def tk02_script_preview(p):
    found = script_ops.script_findings(p.scripts)
    return topk.preview(found, KEY, [F.asc("port"), F.asc("script_id")], 4).select(*KEY, "script_id", "type", "detail", "rank", "more")


@query("""SELECT scan_id, service_key, port, CAST(rn AS INT) AS rank, greatest(n - 5, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, service_key ORDER BY port) AS rn, count(*) OVER (PARTITION BY scan_id, service_key) AS n FROM (
    SELECT DISTINCT scan_id, lower(svc) AS service_key, port FROM exposed_port WHERE svc IS NOT NULL) d) f WHERE rn <= 5""")
def tk02_service_ports_preview(p):
    named = rollups.exposed_ports(p.hosts, p.ports).where("svc IS NOT NULL")
    distinct = named.select("scan_id", F.lower("svc").alias("service_key"), "port").distinct()
    return topk.preview(distinct, ["scan_id", "service_key"], [F.asc("port")], 5).select("scan_id", "service_key", "port", "rank", "more")


@query("""SELECT scan_id, ip, port, proto, CAST(rn AS INT) AS rank, greatest(n - 12, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, ip ORDER BY port, proto) AS rn, count(*) OVER (PARTITION BY scan_id, ip) AS n FROM port_obs WHERE state = 'open') f WHERE rn <= 12""")
def tk02_host_ports_preview(p):
    return topk.preview(filters.open_ports(p.ports), KEY, [F.asc("port"), F.asc("proto")], 12).select(*KEY, "port", "proto", "rank", "more")


@query("SELECT scan_id, ip, port, proto, svc, cleartext_name FROM exposed_port WHERE cleartext_name IS NOT NULL ORDER BY scan_id, ip, port, proto LIMIT 5")
def tk03_first_cleartext(p):
    return topk.first_cleartext(p.ports, p.hosts)


@query(f"SELECT plugin_id, plugin_name, severity, cvss3, entries, hosts FROM ({ROLLUP_SQL}) r ORDER BY severity DESC, entries DESC, plugin_id LIMIT 100")
def tk04_rollup_by_severity(p):
    return topk_rollup(p, "severity")


@query(f"SELECT plugin_id, plugin_name, severity, cvss3, entries, hosts FROM ({ROLLUP_SQL}) r ORDER BY entries DESC, severity DESC, plugin_id LIMIT 100")
def tk04_rollup_by_hosts(p):
    return topk_rollup(p, "hosts")


@query(f"SELECT plugin_id, plugin_name, severity, cvss3, entries, hosts FROM ({ROLLUP_SQL}) r ORDER BY cvss3 DESC, plugin_id LIMIT 100")
def tk04_rollup_by_cvss(p):
    return topk_rollup(p, "cvss")


def topk_rollup(p, by):
    return vulns.sort_rollup(vulns.vulnerability_rollup(p.findings), by).select("plugin_id", "plugin_name", "severity", "cvss3", "entries", "hosts")


def counted_entities(p):
    rows = p.ports.groupBy(*KEY).agg(F.count(F.lit(1)).alias("port_rows"))
    return scored(p).join(rows, KEY, "left").withColumn("port_rows", F.coalesce("port_rows", F.lit(0).cast("bigint")))


def entities(p, by):
    return topk.sort_entities(counted_entities(p), by, 100).select(*KEY, "risk", "port_rows")


ENTITIES_SQL = """SELECT s.scan_id, s.ip, s.risk, coalesce(o.n, 0) AS port_rows
FROM scored_web s LEFT JOIN (SELECT scan_id, ip, count(*) AS n FROM port_obs GROUP BY ALL) o USING (scan_id, ip) ORDER BY {} LIMIT 100"""


@query(ENTITIES_SQL.format("port_rows DESC, scan_id, ip"))
def tk05_entities_by_ports(p):
    return entities(p, "ports")


@query(ENTITIES_SQL.format("risk DESC, scan_id, ip"))
def tk05_entities_by_risk(p):
    return entities(p, "risk")


@query(ENTITIES_SQL.format("ip, scan_id"))
def tk05_entities_by_ip(p):
    return entities(p, "ip")


@query("SELECT scan_id, ip, finding_ord, severity, cvss3 FROM finding")
def tk06_findings_in_order(p):
    return topk.order_findings(p.findings).select(*KEY, "finding_ord", "severity", "cvss3")


@query("""SELECT scan_id, ip, CAST(1 AS INT) AS position, 'OS' AS source, os_name AS value, os_accuracy AS confidence FROM host_obs WHERE os_name IS NOT NULL
UNION ALL SELECT scan_id, ip, 2, 'MAC', mac, NULL FROM host_obs WHERE mac IS NOT NULL
UNION ALL SELECT scan_id, ip, CAST(rn + 2 AS INT), concat(':', port), concat_ws(' ', product, version), NULL FROM (
  SELECT o.*, row_number() OVER (PARTITION BY o.scan_id, o.ip ORDER BY port, proto) AS rn FROM port_obs o JOIN host_obs h USING (scan_id, ip)
  WHERE o.state = 'open' AND o.product IS NOT NULL AND (h.os_name IS NOT NULL OR h.mac IS NOT NULL)) q WHERE rn <= 2""")
def tk07_identification_signals(p):
    return topk.identification_signals(p.hosts, p.ports)


# ------------------------------------------------------------------ windows
@query("""SELECT scan_id, ip, CAST(score AS INT) AS score_weight, min(rn) AS first_rank, max(rn) AS last_rank, round(sum(score / log2(rn + 1)), 6) AS contribution FROM (
  SELECT scan_id, ip, score, row_number() OVER (PARTITION BY scan_id, ip ORDER BY score DESC) AS rn FROM port_facts_web WHERE state = 'open' AND score > 0) r GROUP BY scan_id, ip, score""")
def wn01_weight_ranks(p):
    return risk.weight_ranks(p.ports)


@query("SELECT scan_id, host_id, port, proto, state, svc, product, cpe FROM port_rows")
def wn02_first_wins(p):
    return p.port_rows.select("scan_id", "host_id", "port", "proto", "state", "svc", "product", "cpe")
