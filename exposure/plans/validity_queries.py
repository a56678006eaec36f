"""Scan differences from stored validity runs; those of scans that follow each other have the SQL of the direct queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposure.operators import diff, validity
from exposure.plans import change_queries  # noqa: F401 (registers the SQL)
from exposure.plans.projection import Projection
from exposure.plans.registry import ORACLES, query
from exposure.plans.stream_queries import run_folder

_built: dict[tuple[str, str], str] = {}


def built(p: Projection) -> validity.Validity:
    """The runs of all scans; made once a session and data set."""
    key = (p.spark.sparkContext.applicationId, p.dir)
    if key not in _built:
        path = run_folder(p, "validity")
        validity.write(validity.build(p.runs, p.hosts, p.ports), path)
        _built[key] = path
    return validity.load(p.spark, _built[key])


def from_first(p: Projection) -> DataFrame:
    """Every later scan with the first one."""
    first = p.runs.agg(F.min_by("scan_id", F.struct("started_at", "scan_id"))).scalar()
    return p.runs.select(first.alias("base_id"), F.col("scan_id").alias("comp_id")).where("base_id <> comp_id")


FAR = """SELECT * FROM (WITH far_pair AS (SELECT f.scan_id AS base_id, s.scan_id AS comp_id FROM scan_run s JOIN (SELECT min_by(scan_id, started_at) AS scan_id FROM scan_run) f ON f.scan_id <> s.scan_id),
side AS (SELECT p.base_id, p.comp_id, h.ip, h.scan_id = p.comp_id AS comp, coalesce(h.os_name, '') AS os, h.status FROM far_pair p JOIN host_obs h ON h.scan_id IN (p.base_id, p.comp_id)),
host AS (SELECT base_id, comp_id, ip, bool_or(NOT comp) AS in_base, bool_or(comp) AS in_comp, max(os) FILTER (NOT comp) AS base_os, max(os) FILTER (comp) AS comp_os,
  max(status) FILTER (NOT comp) AS base_status, max(status) FILTER (comp) AS comp_status FROM side GROUP BY ALL),
port AS (SELECT p.base_id, p.comp_id, o.ip, o.port, o.proto, bool_or(o.scan_id = p.comp_id) AS in_comp FROM far_pair p JOIN port_obs o ON o.scan_id IN (p.base_id, p.comp_id)
  WHERE o.state = 'open' GROUP BY ALL HAVING bool_or(o.scan_id = p.comp_id) <> bool_or(o.scan_id = p.base_id))
"""


@query()
def jn06_runs_diff_hosts(p):
    seen = F.col("seen")
    return validity.host_sides(built(p), diff.consecutive_pairs(p.runs)).select(
        "base_id", "comp_id", "ip", (seen != diff.COMP).alias("in_base"), (seen != diff.BASE).alias("in_comp"), "base_os", "comp_os", "base_status", "comp_status"
    )


@query()
def df04_runs_host_diff(p):
    return validity.diff_between(built(p), diff.consecutive_pairs(p.runs))


@query()
def df05_runs_step_log(p):
    return validity.step_log(built(p))


@query()
def ag17_runs_step_summary(p):
    return validity.step_summary(built(p))


@query(f"""{FAR} SELECT base_id, comp_id, ip, CASE WHEN in_comp THEN 'port_added' ELSE 'port_removed' END AS type, concat(port, '/', proto) AS port,
  CAST(NULL AS VARCHAR) AS from_value, CAST(NULL AS VARCHAR) AS to_value FROM (SELECT p.* FROM port p JOIN host h USING (base_id, comp_id, ip) WHERE h.in_base AND h.in_comp) q
UNION ALL SELECT base_id, comp_id, ip, 'os_changed', NULL, base_os, comp_os FROM host WHERE in_base AND in_comp AND base_os <> comp_os
UNION ALL SELECT base_id, comp_id, ip, 'status_changed', NULL, base_status, comp_status FROM host WHERE in_base AND in_comp AND base_status <> comp_status) f""")
def df05_runs_log_from_first(p):
    """Changes since the first scan, as each later scan shows them; the scans between are not read again."""
    return validity.log_between(built(p), from_first(p))


@query()
def tl03_runs_timeline(p):
    v = built(p)
    start = lambda key, name: p.runs.select(F.col("scan_id").alias(key), F.col("started_at").alias(name))
    changed = validity.step_summary(v).where("new_hosts > 0 OR removed_hosts > 0 OR changed_hosts > 0")
    return changed.join(start("base_id", "from_time"), "base_id").join(start("comp_id", "to_time"), "comp_id")


for _name, _like in {
    "jn06_runs_diff_hosts": "jn06_diff_hosts", "df04_runs_host_diff": "df04_host_diff", "df05_runs_step_log": "df05_change_log",
    "ag17_runs_step_summary": "ag17_diff_summary", "tl03_runs_timeline": "tl03_timeline_changes",
}.items():
    ORACLES[_name] = ORACLES[_like]
