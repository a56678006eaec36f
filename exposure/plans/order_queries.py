"""Orders as explicit places, so that a comparison of rows covers the order too."""

from __future__ import annotations

from exposure.functions import columns as C
from exposure.operators import topk
from exposure.plans.fleet_queries import counted_entities
from exposure.plans.registry import query
from exposure.plans.stream_queries import run_folder

KEY = C.HOST_KEY
PLACES_SQL = """SELECT scan_id, ip, row_number() OVER (ORDER BY {}) AS place FROM scored_web s
LEFT JOIN (SELECT scan_id, ip, count(*) AS n FROM port_obs GROUP BY ALL) o USING (scan_id, ip)"""


def places(p, by):
    return topk.place_entities(counted_entities(p).select(*KEY, "risk", "port_rows"), by, run_folder(p, "places")).select(*KEY, "place")


@query(PLACES_SQL.format("risk DESC, scan_id, ip"))
def tk05_places_by_risk(p):
    return places(p, "risk")


@query(PLACES_SQL.format("ip, scan_id"))
def tk05_places_by_ip(p):
    return places(p, "ip")


@query(PLACES_SQL.format("coalesce(n, 0) DESC, scan_id, ip"))
def tk05_places_by_ports(p):
    return places(p, "ports")


@query("""SELECT scan_id, ip, finding_ord, row_number() OVER (PARTITION BY scan_id, ip ORDER BY severity DESC, coalesce(cvss3, 0) DESC, finding_ord) AS place FROM finding""")
def tk06_finding_places(p):
    rows = p.findings.select(*KEY, "finding_ord", "severity", "cvss", "cvss3")
    return topk.place_findings(rows, run_folder(p, "finding-places")).select(*KEY, "finding_ord", "place")
