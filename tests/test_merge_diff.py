"""Merging against a scan-by-scan fold, and scan differences."""

import datetime
import random

import pytest

from conftest import FINDING, HOST, PORT
from exposure import dims
from exposure.operators import diff, merge
from pyspark.sql import functions as F


def random_scans(seed):
    rng = random.Random(seed)
    hosts, ports, findings = [], [], []
    for scan in range(1, 6):
        for ip in rng.sample(["a", "b", "c", "d"], rng.randint(1, 4)):
            hosts.append({
                "scan_id": scan, "ip": ip, "mac": rng.choice([None, f"m{scan}"]), "hostname": rng.choice([None, f"h{scan}"]), "status": rng.choice(["up", "down"]),
                "os_name": (name := rng.choice([None, f"os{scan}"])), "os_accuracy": rng.choice([80, 90]) if name else None,
            })
            for port in rng.sample([1, 2, 3], rng.randint(0, 3)):
                ports.append({"scan_id": scan, "ip": ip, "port": port, "proto": "tcp", "state": rng.choice(["open", "closed"]), "svc": f"s{scan}", "product": rng.choice([None, f"p{scan}"])})
            for n in range(rng.randint(0, 4)):
                findings.append({"scan_id": scan, "ip": ip, "finding_ord": n, "plugin_id": rng.randint(1, 2), "port": rng.randint(1, 2), "severity": 1})
    return hosts, ports, findings


def fold(hosts, ports, findings, profile):
    """The reference's rules applied one scan at a time."""
    state = {}
    for h in hosts:
        mine = [p for p in ports if (p["scan_id"], p["ip"]) == (h["scan_id"], h["ip"])]
        found = [f for f in findings if (f["scan_id"], f["ip"]) == (h["scan_id"], h["ip"])]
        if h["ip"] not in state:
            state[h["ip"]] = {**h, "ports": {p["port"]: p for p in mine}, "findings": list(found)}
            continue
        old = state[h["ip"]]
        for p in mine:
            if p["port"] not in old["ports"] or (profile == "web" and p["product"] and not old["ports"][p["port"]]["product"]):
                old["ports"][p["port"]] = p
        if h["os_name"] and (not old["os_name"] or h["os_accuracy"] > old["os_accuracy"]):
            old["os_name"], old["os_accuracy"] = h["os_name"], h["os_accuracy"]
        if profile == "web":
            old["status"] = "up" if h["status"] == "up" else old["status"]
            seen = {(f["plugin_id"], f["port"]) for f in old["findings"]}
            for f in found:
                if (f["plugin_id"], f["port"]) not in seen:
                    seen.add((f["plugin_id"], f["port"]))
                    old["findings"].append(f)
        else:
            old["hostname"], old["mac"] = old["hostname"] or h["hostname"], old["mac"] or h["mac"]
            seen = {f["plugin_id"] for f in old["findings"]}
            old["findings"] += [f for f in found if f["plugin_id"] not in seen]
    return state


@pytest.mark.parametrize("profile", dims.PROFILES)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_pass_equals_the_fold(rows, profile, seed):
    hosts, ports, findings = random_scans(seed)
    load = lambda df: df.withColumn("load_ord", df["scan_id"].cast("bigint"))
    h, p, f = load(rows(hosts, HOST)), load(rows(ports, PORT)), load(rows(findings, FINDING))
    want = fold(hosts, ports, findings, profile)
    got = {r.ip: r for r in merge.merge_hosts(h, profile).collect()}
    fields = ("status", "hostname", "mac", "os_name", "os_accuracy")
    assert {ip: tuple(r[c] for c in fields) for ip, r in got.items()} == {ip: tuple(s[c] for c in fields) for ip, s in want.items()}
    got_ports = {(r.ip, r.port): (r.svc, r.product, r.state) for r in merge.merge_ports(p, profile).collect()}
    assert got_ports == {(ip, n): (q["svc"], q["product"], q["state"]) for ip, s in want.items() for n, q in s["ports"].items()}
    key = lambda r: (r["ip"], r["plugin_id"], r["port"], r["finding_ord"])
    got_findings = sorted((*key(r), r["load_ord"]) for r in merge.merge_findings(f, h, profile).collect())
    assert got_findings == sorted((*key(x), x["scan_id"]) for s in want.values() for x in s["findings"])


def test_merging_a_scan_with_itself_changes_nothing(rows):
    hosts, ports, _ = random_scans(4)
    hosts, ports = [h for h in hosts if h["scan_id"] == 1], [p for p in ports if p["scan_id"] == 1]
    df = lambda data, schema, load: rows(data, schema).selectExpr("*", f"{load}L AS load_ord")
    once = merge.merge_ports(df(ports, PORT, 1)).collect()
    twice = merge.merge_ports(df(ports, PORT, 1).unionByName(df(ports, PORT, 2))).collect()
    assert sorted(once) == sorted(twice)
    names = ["ip", "status", "hostname", "mac", "os_name", "os_accuracy"]
    one = merge.merge_hosts(df(hosts, HOST, 1)).select(*names).collect()
    two = merge.merge_hosts(df(hosts, HOST, 1).unionByName(df(hosts, HOST, 2))).select(*names).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_desktop_trace_takes_the_longer(rows):
    schema = "scan_id int, ip string, hop_ord int, ttl int, hop_ip string, load_ord bigint"
    hop = lambda load, n, ip: {"scan_id": load, "ip": "a", "hop_ord": n, "ttl": n, "hop_ip": ip, "load_ord": load}
    trace = rows([hop(1, 1, "x"), hop(2, 1, "y"), hop(2, 2, "z"), hop(3, 1, "q"), hop(3, 2, "r")], schema)
    pick = lambda profile: sorted(r.hop_ip for r in merge.merge_trace(trace, profile).collect())
    assert pick("web") == ["x"] and pick("desktop") == ["y", "z"]


def test_diff_of_a_scan_with_itself_is_unchanged(rows, spark):
    hosts, ports, _ = random_scans(6)
    pairs = diff.scan_pair(spark, 2, 2)
    out = diff.host_diff(rows(hosts, HOST), rows(ports, PORT), pairs).collect()
    assert out and {r["diff"] for r in out} == {"unchanged"}


def test_change_log_kinds(rows, spark):
    host = lambda scan, ip, **kw: {"scan_id": scan, "ip": ip, "status": "up", **kw}
    port = lambda scan, ip, n, state="open": {"scan_id": scan, "ip": ip, "port": n, "proto": "tcp", "state": state}
    hosts = rows([host(1, "a", os_name="x"), host(2, "a", status="down"), host(1, "b"), host(2, "c"), host(1, "d"), host(2, "d")], HOST)
    ports = rows([port(1, "a", 22), port(2, "a", 80), port(2, "a", 81, "closed"), port(1, "b", 22), port(2, "c", 22), port(1, "d", 5), port(2, "d", 5)], PORT)
    pairs = diff.scan_pair(spark, 1, 2)
    log = {(r.ip, r.type, r.port, r.from_value, r.to_value) for r in diff.change_log(hosts, ports, pairs).collect()}
    assert log == {
        ("a", "port_added", "80/tcp", None, None), ("a", "port_removed", "22/tcp", None, None),
        ("a", "os_changed", None, "x", ""), ("a", "status_changed", None, "up", "down"),
    }
    assert {(r.ip, r["diff"], r.changes) for r in diff.host_diff(hosts, ports, pairs).collect()} == {
        ("a", "changed", 4), ("b", "removed", 0), ("c", "new", 0), ("d", "unchanged", 0),
    }


def test_consecutive_pairs_cross_seconds_days_and_ties(rows):
    rng = random.Random(9)
    start = datetime.datetime(2024, 1, 1)
    times = [start + datetime.timedelta(days=rng.choice([0, 1, 5]), seconds=rng.choice([0, 1, 70000]), microseconds=rng.choice([0, 5])) for _ in range(30)]
    runs = rows([{"scan_id": i, "started_at": t} for i, t in enumerate(times)], "scan_id int, started_at timestamp")
    ordered = sorted(range(30), key=lambda i: (times[i], i))
    assert sorted(map(tuple, diff.consecutive_pairs(runs).collect())) == sorted(zip(ordered, ordered[1:]))


def test_import_report(rows):
    host = lambda ip, status="up": {"scan_id": 1, "ip": ip, "status": status}
    report = merge.import_report(rows([host("a"), host("b", "down")], HOST), rows([host("b"), host("c", "down")], HOST)).first()
    assert (report.added, report.updated, report.total, report.up, report.down, report.findings) == (1, 1, 3, 2, 1, 0)


@pytest.mark.parametrize("profile", ["web", "desktop"])
def test_findings_before_or_without_their_host_stay(rows, profile):
    hosts = rows([{"scan_id": 2, "ip": "a", "status": "up"}], HOST).withColumn("load_ord", F.col("scan_id").cast("bigint"))
    findings = rows([{"scan_id": s, "ip": ip, "finding_ord": 0, "plugin_id": s, "port": 1, "severity": 1} for s, ip in ((1, "a"), (2, "a"), (3, "nowhere"))], FINDING)
    kept = merge.merge_findings(findings.withColumn("load_ord", F.col("scan_id").cast("bigint")), hosts, profile)
    assert sorted((r.ip, r.plugin_id) for r in kept.collect()) == [("a", 1), ("a", 2), ("nowhere", 3)]


def test_the_first_port_of_a_document_wins(spark):
    schema = "scan_id int, ip string, port int, proto string, state string, product string, load_ord bigint, host_ord int, port_ord int"
    ports = spark.createDataFrame([(1, "a", 80, "tcp", "open", None, 1, 0, 0), (1, "a", 80, "tcp", "closed", None, 1, 0, 1), (1, "b", 80, "tcp", "open", None, 1, 3, 0), (1, "b", 80, "tcp", "closed", None, 1, 2, 5)], schema)
    for profile in ("web", "desktop"):
        assert sorted((r.ip, r.state) for r in merge.merge_ports(ports, profile).collect()) == [("a", "open"), ("b", "closed")]


def test_script_results_count_once(spark):
    rows = [("a", 22, "s", "late", 2), ("a", 22, "s", "early", 1), ("a", None, "t", None, 1), ("a", None, "t", None, 2)]
    scripts = spark.createDataFrame(rows, "ip string, port int, script_id string, output string, load_ord bigint")
    assert sorted((r.script_id, r.output) for r in merge.merge_scripts(scripts).collect()) == [("s", "early"), ("t", None)]
