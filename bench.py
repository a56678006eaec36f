"""Times the headline queries over ``$BENCH_SF_DIR`` and prints one JSON line.

Every query runs to completion into the ``noop`` sink, so all rows and columns are
computed and nothing is collected. Queries run once each, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "ag01_host_risk", "ag03_dashboard", "ag08_vulnerability_rollup", "ag10_port_rollup", "ag11_service_rollup", "ag15_postings",
    "df05_change_log", "fl16_search_text", "fl18_visible_counts", "gr03_by_service", "jn05_cve_match", "mg01_merge_hosts",
    "mg02_merge_ports", "mg04_merge_findings", "ns03_script_findings", "sc02_nmap_ports", "sc09_nessus_findings", "sk01_host_sheet",
    "tk01_top_risky_hosts", "tk02_findings_preview", "tl03_timeline_changes", "tp05_edge_weights",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from exposure.plans.queries import QUERIES
    from exposure.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "exposure-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    wanted = sys.argv[1:] or HEADLINE
    run("fl01_open_ports")
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
