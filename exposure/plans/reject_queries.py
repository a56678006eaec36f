"""Reports with broken elements: what the readers take, what they leave and why.

Hosts that are down are cut off inside a tag and hosts without a name lose their addresses; nothing else is changed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from exposure.plans import render
from exposure.plans.projection import Projection
from exposure.plans.registry import query
from exposure.sources import accounts, nmap


def broken_elements(p: Projection):
    named = F.col("hostname").isNotNull()
    up = F.col("status") == "up"
    written = lambda chosen: render.nmap_hosts(p.hosts.where(chosen), p.ports).select("scan_id", "host_ord", "xml")
    cut = F.concat(F.substring_index("xml", "<address", 1), F.lit("<addr"))
    bare = F.regexp_replace("xml", r"<address[^>]*>(\s*</address>)?", "")
    whole, down, unnamed = written(up & named), written(~up).withColumn("xml", cut), written(up & ~named).withColumn("xml", bare)
    return accounts.checked(whole.unionByName(down).unionByName(unnamed), "nmap", F.col("xml"))


@query("""SELECT scan_id, count(*) AS elements, count(*) FILTER (status = 'up' AND hostname IS NOT NULL) AS rows, count(*) FILTER (status <> 'up') AS malformed,
  count(*) FILTER (status = 'up' AND hostname IS NULL) AS without_address FROM host_obs GROUP BY scan_id""")
def sc02_report_accounts(p):
    return accounts.report_accounts(broken_elements(p))


@query("""SELECT h.scan_id, h.ip, count(o.port) AS ports FROM host_obs h LEFT JOIN port_obs o USING (scan_id, ip) WHERE status = 'up' AND hostname IS NOT NULL GROUP BY ALL""")
def sc02_accepted_hosts(p):
    nested = accounts.accepted(broken_elements(p))
    return nested.select("scan_id", "ip", F.coalesce(F.size("h.ports.port"), F.lit(0)).cast("bigint").alias("ports"))
