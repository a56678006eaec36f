"""The bundle of tables an analysis runs over."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Inventory:
    """Normalised scan tables; every host-level table carries ``scan_id`` and ``ip``.

    ``hosts``    scan_id, ip, mac, hostname, status, os_name, os_accuracy
    ``ports``    scan_id, ip, port, proto, state, svc, product, version, cpe
    ``findings`` scan_id, ip, finding_ord, plugin_id, plugin_name, severity, cvss, cvss3,
                 exploit_available, cves, port, proto
    ``scripts``  scan_id, ip, port (null at host level), script_id, output
    ``trace``    scan_id, ip, hop_ord, ttl, hop_ip, hop_host, rtt
    ``tags``     asset_key, labels, owner, notes, last_ip, last_seen
    ``vuln_db``  cpe, ord, cve, cvss, severity, descr
    ``runs``     scan_id, source_name, started_at

    A merged inventory is the same set of tables under a single ``scan_id``.
    """

    hosts: DataFrame
    ports: DataFrame
    findings: DataFrame | None = None
    scripts: DataFrame | None = None
    trace: DataFrame | None = None
    tags: DataFrame | None = None
    vuln_db: DataFrame | None = None
    runs: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> "Inventory":
        return replace(self, **tables)
