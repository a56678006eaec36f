"""The projected tables and lookups again, as ANSI SQL for the oracle.

Written independently of ``projection.py``: this text is what DuckDB runs over the
raw Parquet tables to check the Spark results.
"""

from __future__ import annotations

import re

from exposure import dims


def _values(name: str, columns: str, rows) -> str:
    def lit(v):
        return "NULL" if v is None else ("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v))

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {name}_v({columns})"


VIEWS = {
    "host_dim": """
SELECT CAST(c_custkey AS BIGINT) AS host_id, c_nationkey,
  concat(CAST(10 + (c_custkey // 65536) % 200 AS VARCHAR), '.', c_nationkey, '.', (c_custkey // 256) % 256, '.', c_custkey % 256) AS ip,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('aa:bb:cc:', lpad(CAST((c_custkey // 10000) % 100 AS VARCHAR), 2, '0'), ':',
    lpad(CAST((c_custkey // 100) % 100 AS VARCHAR), 2, '0'), ':', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0')) END AS mac,
  lower(c_name) AS full_name, CAST(80 + c_custkey % 21 AS INT) AS os_accuracy
FROM customer""",
    "port_rows": """
SELECT host_id, scan_id, port, proto,
  CASE l_returnflag WHEN 'R' THEN 'closed' WHEN 'A' THEN 'filtered' ELSE 'open' END AS state,
  CASE l_partkey % 24 WHEN 0 THEN 'ssh' WHEN 1 THEN 'http' WHEN 2 THEN 'https' WHEN 3 THEN 'ftp' WHEN 4 THEN 'telnet' WHEN 5 THEN 'smtp' WHEN 6 THEN 'pop3'
    WHEN 7 THEN 'imap' WHEN 8 THEN 'snmp' WHEN 9 THEN 'LDAP' WHEN 10 THEN 'microsoft-ds' WHEN 11 THEN 'ms-sql-s' WHEN 12 THEN 'docker' WHEN 13 THEN 'mysql'
    WHEN 14 THEN 'ms-wbt-server' WHEN 15 THEN 'postgresql' WHEN 16 THEN 'redis' WHEN 17 THEN 'kubernetes' WHEN 18 THEN 'http-proxy' WHEN 21 THEN 'tcpwrapped'
    WHEN 23 THEN 'telnet' ELSE NULL END AS svc,
  CASE WHEN l_partkey % 3 = 0 THEN concat('prod', l_partkey % 24) ELSE NULL END AS product,
  CASE WHEN l_partkey % 6 = 0 THEN concat(l_partkey % 7, '.', l_partkey % 4) ELSE NULL END AS version,
  CASE WHEN l_partkey % 2 = 0 THEN concat('cpe:/a:v', l_partkey % 5, ':prod', l_partkey // 40, ':', l_partkey % 11) ELSE NULL END AS cpe
FROM (SELECT *, row_number() OVER (PARTITION BY host_id, scan_id, port, proto
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS rn
  FROM (SELECT CAST(o_custkey AS BIGINT) AS host_id, CAST(year(o_orderdate) AS INT) AS scan_id,
      CAST(CASE l_partkey % 24 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 21 WHEN 4 THEN 23 WHEN 5 THEN 25 WHEN 6 THEN 110 WHEN 7 THEN 143
        WHEN 8 THEN 161 WHEN 9 THEN 389 WHEN 10 THEN 445 WHEN 11 THEN 1433 WHEN 12 THEN 2375 WHEN 13 THEN 3306 WHEN 14 THEN 3389 WHEN 15 THEN 5432
        WHEN 16 THEN 6379 WHEN 17 THEN 6443 WHEN 18 THEN 8080 WHEN 19 THEN 9200 WHEN 20 THEN 10250 WHEN 21 THEN 49152 WHEN 22 THEN 62078 ELSE 9081 END AS INT) AS port,
      CASE WHEN l_suppkey % 10 = 0 THEN 'udp' ELSE 'tcp' END AS proto,
      l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey) a) b WHERE rn = 1""",
    "port_obs": """
SELECT scan_id, ip, port, proto, state, svc, product, version, cpe FROM port_rows JOIN host_dim USING (host_id)""",
    "host_obs": """
SELECT s.scan_id, h.ip, h.mac,
  CASE WHEN (h.host_id + s.scan_id) % 4 = 0 THEN NULL ELSE h.full_name END AS hostname,
  CASE WHEN (h.host_id + s.scan_id) % 10 = 9 THEN 'down' ELSE 'up' END AS status,
  CASE (h.c_nationkey + CASE WHEN (h.host_id + s.scan_id) % 5 = 0 THEN 1 ELSE 0 END) % 7 WHEN 0 THEN 'Microsoft Windows Server 2019' WHEN 1 THEN 'Linux 4.15 - 5.19'
    WHEN 2 THEN 'Ubuntu 22.04' WHEN 3 THEN 'Cisco IOS 15' WHEN 4 THEN 'Fortinet FortiOS' WHEN 5 THEN 'Apple macOS 12' ELSE NULL END AS os_name,
  h.os_accuracy, h.host_id
FROM host_dim h JOIN (SELECT DISTINCT host_id, scan_id FROM port_rows) s ON h.host_id = s.host_id""",
    "report_item": """
SELECT CAST(1995 + e.event_id % 7 AS INT) AS scan_id, h.ip, e.event_id AS finding_ord, CAST(e.event_id % 97 AS INT) AS plugin_id,
  concat('Plugin ', e.event_id % 97) AS plugin_name, CAST(e.event_id % 97 % 5 AS INT) AS severity,
  e.event_id % 97 % 4 = 0 AS exploit_available, CAST(e.event_id % 97 AS DOUBLE) / 10 AS cvss3,
  CAST(CASE e.event_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 443 ELSE 445 END AS INT) AS port, 'tcp' AS proto,
  concat('CVE-2024-', 1000 + e.event_id % 97) AS cve, e.ts AS seen_at, e.event_id, h.host_id
FROM events e JOIN host_dim h ON h.host_id = CASE WHEN e.event_id % 3 = 0 THEN 7 ELSE e.event_id % (SELECT count(*) FROM customer) END""",
    "finding": """
SELECT *, CASE severity WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity_label
FROM report_item WHERE severity > 0""",
    "vuln_db": """
SELECT concat('cpe:2.3:a:v', p_partkey % 5, ':prod', p_partkey // 40, ':', p_partkey % 11, ':*:*:*:*:*:*:*') AS cpe, p_partkey AS ord,
  concat('CVE-', 2000 + p_size % 25, '-', p_partkey) AS cve, CAST(p_partkey % 101 AS DOUBLE) / 10 AS cvss, p_name AS descr FROM part""",
    "asset_tag": """
SELECT CASE WHEN mac IS NULL THEN concat('ip:', ip) ELSE concat('mac:', upper(mac)) END AS asset_key,
  CASE (host_id // 5) % 8 WHEN 0 THEN 'ckt' WHEN 1 THEN 'mission-critical' WHEN 2 THEN 'crown' WHEN 3 THEN 'choke' WHEN 4 THEN 'pivot' WHEN 5 THEN 'production'
    WHEN 6 THEN 'staging' ELSE 'p1' END AS label,
  CASE WHEN host_id % 15 = 0 THEN 'soc' ELSE NULL END AS owner, CASE WHEN host_id % 35 = 0 THEN 'note' ELSE NULL END AS notes, ip AS last_ip, host_id
FROM host_dim""",
    "trace_hop": """
SELECT 0 AS scan_id, h.ip, CAST(t.ttl AS INT) AS ttl,
  CASE t.ttl WHEN 1 THEN concat('10.255.', n.n_regionkey, '.1')
    WHEN 2 THEN CASE WHEN n.n_nationkey % 9 = 0 THEN '*' ELSE concat('10.254.', n.n_nationkey, '.1') END ELSE h.ip END AS hop_ip,
  CASE t.ttl WHEN 1 THEN concat('core', n.n_regionkey) ELSE NULL END AS hop_host, CAST(t.ttl * (1 + h.host_id % 7) AS DOUBLE) / 4 AS rtt
FROM host_dim h JOIN nation n ON h.c_nationkey = n.n_nationkey CROSS JOIN (SELECT 1 AS ttl UNION ALL SELECT 2 UNION ALL SELECT 3) t""",
    "script_host": """
SELECT 0 AS scan_id, ip, host_id,
  CAST(CASE WHEN host_id % 2 = 0 THEN CASE host_id % 3 WHEN 0 THEN 443 WHEN 1 THEN 80 ELSE 22 END END AS INT) AS port,
  CASE host_id % 10 WHEN 0 THEN 'ssl-cert' WHEN 1 THEN 'http-title' WHEN 2 THEN 'http-server-header' WHEN 3 THEN 'smb-os-discovery' WHEN 4 THEN 'ssh-hostkey'
    WHEN 5 THEN 'ftp-anon' WHEN 6 THEN 'ms-sql-info' WHEN 7 THEN 'mysql-info' WHEN 8 THEN 'smb-vuln-ms17-010' ELSE 'unknown-script' END AS script_id,
  full_name
FROM host_dim""",
    "scan_run": """
SELECT CAST(year(o_orderdate) AS INT) AS scan_id, min(o_orderdate) AS started_at, max(o_orderdate) AS finished_at,
  concat('scan-', year(o_orderdate)) AS source_name FROM orders GROUP BY year(o_orderdate)""",
    "scan_pair": """
SELECT base_id, comp_id FROM (SELECT lag(scan_id) OVER (ORDER BY started_at, scan_id) AS base_id, scan_id AS comp_id FROM scan_run) p
WHERE base_id IS NOT NULL""",
    "latest_host": """
SELECT 0 AS scan_id, ip, mac, hostname, status, os_name, os_accuracy, host_id
FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY scan_id DESC) AS rn FROM host_obs) l WHERE rn = 1""",
    "port_facts_web": """
SELECT *, weight + CASE WHEN cleartext_name IS NULL THEN 0 ELSE 3 END AS score FROM (
  SELECT p.*, greatest(coalesce(d.port_weight, 0), coalesce(s.svc_weight, 0)) AS weight, coalesce(d.port_cleartext, s.svc_cleartext) AS cleartext_name
  FROM port_obs p LEFT JOIN port_dim_web d ON p.port = d.port LEFT JOIN service_dim_web s ON p.svc = s.svc_key) f""",
    "port_facts_desktop": """
SELECT *, weight + CASE WHEN cleartext_name IS NULL THEN 0 ELSE 3 END AS score FROM (
  SELECT p.*, greatest(coalesce(d.port_weight, 0), coalesce(s.svc_weight, 0)) AS weight, coalesce(d.port_cleartext, s.svc_cleartext) AS cleartext_name
  FROM port_obs p LEFT JOIN port_dim_desktop d ON p.port = d.port LEFT JOIN service_dim_desktop s ON lower(p.svc) = s.svc_key) f""",
    "finding_weight": """
SELECT *, CASE severity WHEN 4 THEN 25 WHEN 3 THEN 15 WHEN 2 THEN 5 ELSE 1 END + CASE WHEN exploit_available THEN 5 ELSE 0 END AS weight FROM finding""",
    "port_risk_web": """
SELECT scan_id, ip, sum(score / log2(rn + 1)) AS risk FROM (
  SELECT scan_id, ip, score, row_number() OVER (PARTITION BY scan_id, ip ORDER BY score DESC) AS rn FROM port_facts_web WHERE state = 'open' AND score > 0) r
GROUP BY scan_id, ip""",
    "port_risk_desktop": """
SELECT scan_id, ip, sum(score / log2(rn + 1)) AS risk FROM (
  SELECT scan_id, ip, score, row_number() OVER (PARTITION BY scan_id, ip ORDER BY score DESC) AS rn FROM port_facts_desktop WHERE state = 'open' AND score > 0) r
GROUP BY scan_id, ip""",
    "finding_risk": """
SELECT scan_id, ip, sum(weight / log2(rn + 1)) AS risk, sum(weight) AS linear FROM (
  SELECT scan_id, ip, weight, row_number() OVER (PARTITION BY scan_id, ip ORDER BY weight DESC) AS rn FROM finding_weight) r GROUP BY scan_id, ip""",
    "port_count": """
SELECT scan_id, ip, count(*) FILTER (state = 'open') AS open_ports, count(*) FILTER (state = 'filtered') AS filtered_ports,
  count(*) FILTER (state = 'open' AND cleartext_name IS NOT NULL) AS cleartext_ports FROM port_facts_web GROUP BY scan_id, ip""",
    "finding_count": """
SELECT scan_id, ip, count(*) AS findings, count(*) FILTER (severity = 4) AS critical_findings, count(*) FILTER (severity = 3) AS high_findings,
  count(*) FILTER (severity = 2) AS medium_findings, count(*) FILTER (severity = 1) AS low_findings FROM finding GROUP BY scan_id, ip""",
    "scored_web": """
SELECT h.*, coalesce(c.open_ports, 0) AS open_ports, coalesce(c.filtered_ports, 0) AS filtered_ports, coalesce(c.cleartext_ports, 0) AS cleartext_ports,
  coalesce(n.findings, 0) AS findings, coalesce(n.critical_findings, 0) AS critical_findings, coalesce(n.high_findings, 0) AS high_findings,
  coalesce(n.medium_findings, 0) AS medium_findings, coalesce(n.low_findings, 0) AS low_findings,
  CAST(least(100, round(round(greatest(coalesce(p.risk, 0), coalesce(f.risk, 0)), 9))) AS INT) AS risk
FROM host_obs h LEFT JOIN port_risk_web p USING (scan_id, ip) LEFT JOIN finding_risk f USING (scan_id, ip)
  LEFT JOIN port_count c USING (scan_id, ip) LEFT JOIN finding_count n USING (scan_id, ip)""",
    "scored_desktop": """
SELECT h.*, (SELECT count(*) FROM port_facts_desktop q WHERE q.scan_id = h.scan_id AND q.ip = h.ip AND q.state = 'open') AS open_ports,
  (SELECT count(*) FROM port_facts_desktop q WHERE q.scan_id = h.scan_id AND q.ip = h.ip AND q.state = 'open' AND q.cleartext_name IS NOT NULL) AS cleartext_ports,
  CAST(least(100, floor(round(greatest(coalesce(p.risk, 0), coalesce(f.linear, 0)), 9))) AS INT) AS risk
FROM host_obs h LEFT JOIN port_risk_desktop p USING (scan_id, ip) LEFT JOIN finding_risk f USING (scan_id, ip)""",
    "cve_match": """
SELECT scan_id, ip, cve, cvss, port, cpe, match, descr FROM (
  SELECT o.scan_id, o.ip, v.cve, v.cvss, o.port, v.cpe, v.descr,
    CASE WHEN split_part(o.cpe, ':', 5) = split_part(v.cpe, ':', 6) THEN 'exact' ELSE 'prefix' END AS match,
    row_number() OVER (PARTITION BY o.scan_id, o.ip, v.cve
      ORDER BY o.port, CASE WHEN split_part(o.cpe, ':', 5) = split_part(v.cpe, ':', 6) THEN 0 ELSE 1 END, v.cpe, v.ord) AS rn
  FROM (SELECT *, array_to_string(list_slice(string_split(replace(cpe, 'cpe:/', 'cpe:2.3:'), ':'), 1, 5), ':') AS stem FROM port_obs WHERE state = 'open' AND cpe IS NOT NULL) o
  JOIN (SELECT *, array_to_string(list_slice(string_split(cpe, ':'), 1, 5), ':') AS stem FROM vuln_db) v ON o.stem = v.stem) m
WHERE rn = 1""",
    "host_label": """
SELECT h.*, t.label, t.owner, t.notes, CASE WHEN h.mac IS NULL THEN concat('ip:', h.ip) ELSE concat('mac:', upper(h.mac)) END AS asset_key
FROM host_obs h LEFT JOIN asset_tag t ON t.asset_key = CASE WHEN h.mac IS NULL THEN concat('ip:', h.ip) ELSE concat('mac:', upper(h.mac)) END""",
    "exposed_port": """
SELECT p.* FROM port_facts_web p JOIN host_obs h USING (scan_id, ip) WHERE p.state = 'open' AND h.status = 'up'""",
    "open_pair": """
SELECT DISTINCT p.base_id, p.comp_id, o.ip, o.port, o.proto, o.scan_id = p.base_id AS in_base FROM scan_pair p
JOIN port_obs o ON o.scan_id IN (p.base_id, p.comp_id) WHERE o.state = 'open'""",
    "host_pair": """
SELECT coalesce(b.base_id, c.base_id) AS base_id, coalesce(b.comp_id, c.comp_id) AS comp_id, coalesce(b.ip, c.ip) AS ip,
  b.ip IS NOT NULL AS in_base, c.ip IS NOT NULL AS in_comp, b.os_name AS base_os, c.os_name AS comp_os, b.status AS base_status, c.status AS comp_status
FROM (SELECT p.*, h.ip, h.os_name, h.status FROM scan_pair p JOIN host_obs h ON h.scan_id = p.base_id) b
FULL OUTER JOIN (SELECT p.*, h.ip, h.os_name, h.status FROM scan_pair p JOIN host_obs h ON h.scan_id = p.comp_id) c
  ON b.base_id = c.base_id AND b.comp_id = c.comp_id AND b.ip = c.ip""",
    "port_change": """
SELECT base_id, comp_id, ip, port, proto, CASE WHEN bool_or(in_base) THEN 'port_removed' ELSE 'port_added' END AS type
FROM open_pair GROUP BY base_id, comp_id, ip, port, proto HAVING bool_or(in_base) <> bool_or(NOT in_base)""",
    "change_row": """
SELECT c.base_id, c.comp_id, c.ip, c.type, concat(c.port, '/', c.proto) AS port, CAST(NULL AS VARCHAR) AS from_value, CAST(NULL AS VARCHAR) AS to_value
  FROM port_change c JOIN host_pair h USING (base_id, comp_id, ip) WHERE h.in_base AND h.in_comp
UNION ALL SELECT base_id, comp_id, ip, 'os_changed', NULL, coalesce(base_os, ''), coalesce(comp_os, '') FROM host_pair
  WHERE in_base AND in_comp AND coalesce(base_os, '') <> coalesce(comp_os, '')
UNION ALL SELECT base_id, comp_id, ip, 'status_changed', NULL, base_status, comp_status FROM host_pair WHERE in_base AND in_comp AND base_status <> comp_status""",
    "host_diff": """
SELECT h.base_id, h.comp_id, h.ip, CASE WHEN NOT in_base THEN 'new' WHEN NOT in_comp THEN 'removed' WHEN n.changes > 0 THEN 'changed' ELSE 'unchanged' END AS diff,
  CASE WHEN in_base AND in_comp THEN coalesce(n.changes, 0) ELSE 0 END AS changes
FROM host_pair h LEFT JOIN (SELECT base_id, comp_id, ip, count(*) AS changes FROM change_row GROUP BY base_id, comp_id, ip) n USING (base_id, comp_id, ip)""",
    "scan_total": """
SELECT r.scan_id, r.source_name, r.started_at, h.hosts, h.hosts_up, p.open_ports FROM scan_run r
JOIN (SELECT scan_id, count(*) AS hosts, count(*) FILTER (status = 'up') AS hosts_up FROM host_obs GROUP BY scan_id) h USING (scan_id)
JOIN (SELECT scan_id, count(*) FILTER (state = 'open') AS open_ports FROM port_obs GROUP BY scan_id) p USING (scan_id)""",
    "up_hop": """
SELECT t.* FROM trace_hop t JOIN latest_host h USING (scan_id, ip) WHERE h.status = 'up' AND t.hop_ip <> '*'""",
    "topo_edge": """
SELECT scan_id, ip, coalesce(lag(hop_ip) OVER (PARTITION BY ip ORDER BY ttl), 'scanner') AS from_node, hop_ip AS to_node, ttl FROM up_hop
UNION ALL SELECT h.scan_id, h.ip, coalesce(l.last_hop, 'scanner'), h.ip, NULL FROM latest_host h
  LEFT JOIN (SELECT ip, max_by(hop_ip, ttl) AS last_hop FROM up_hop GROUP BY ip) l USING (ip) WHERE h.status = 'up' AND coalesce(l.last_hop, 'scanner') <> h.ip""",
    "topo_node": """
SELECT 0 AS scan_id, 'scanner' AS node, 'scanner' AS type, 'Scanner' AS label, CAST(NULL AS INT) AS ttl, 0 AS level
UNION ALL SELECT 0, ip, 'target', coalesce(hostname, ip), NULL, 10 FROM latest_host WHERE status = 'up'
UNION ALL SELECT 0, hop_ip, 'hop', label, ttl, ttl FROM (SELECT hop_ip, coalesce(hop_host, hop_ip) AS label, ttl, row_number() OVER (PARTITION BY hop_ip ORDER BY ip, ttl) AS rn
  FROM up_hop WHERE hop_ip NOT IN (SELECT ip FROM latest_host WHERE status = 'up')) q WHERE rn = 1""",
    "script_found": """
SELECT scan_id, ip, port, script_id, host_id,
  CASE script_id WHEN 'ssl-cert' THEN 'cert' WHEN 'http-title' THEN 'http' WHEN 'http-server-header' THEN 'http' WHEN 'smb-os-discovery' THEN 'smb' WHEN 'ssh-hostkey' THEN 'ssh'
    WHEN 'ftp-anon' THEN 'ftp' WHEN 'ms-sql-info' THEN 'mssql' ELSE 'mysql' END AS type,
  CASE script_id WHEN 'ssl-cert' THEN concat('commonName=', full_name) WHEN 'http-title' THEN concat('page ', host_id % 11) WHEN 'http-server-header' THEN 'nginx'
    WHEN 'smb-os-discovery' THEN 'Windows Server' WHEN 'ssh-hostkey' THEN 'ssh-rsa, ssh-ed25519' WHEN 'ftp-anon' THEN CASE WHEN host_id % 20 = 5 THEN 'Anonymous FTP!' ELSE 'ftp-anon' END
    WHEN 'ms-sql-info' THEN concat('15.', host_id % 4) ELSE concat('5.7.', host_id % 4) END AS detail, full_name
FROM script_host WHERE script_id NOT IN ('smb-vuln-ms17-010', 'unknown-script')""",
    "port_dim_web": _values("pw", "port, port_weight, port_cleartext", dims.port_rows("web")),
    "port_dim_desktop": _values("pd", "port, port_weight, port_cleartext", dims.port_rows("desktop")),
    "service_dim_web": _values("sw", "svc_key, svc_weight, svc_cleartext", dims.service_rows("web")),
    "service_dim_desktop": _values("sd", "svc_key, svc_weight, svc_cleartext", dims.service_rows("desktop")),
    "admin_dim": _values("ad", "port, admin_name, admin_category, admin_severity, admin_rank, admin_description", dims.admin_rows()),
    "service_group_dim": _values("sg", "port, service_group, group_order", dims.service_group_rows()),
    "tag_label_dim": _values("tl", "label, category, display", dims.TAG_LABELS),
}


def _needed(text: str, found: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def with_views(body: str) -> str:
    """``body`` preceded by the views it names, each in dependency order."""
    names = _needed(body, [])
    if not names:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names) + "\n" + body.strip()
