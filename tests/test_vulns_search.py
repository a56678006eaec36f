"""CVE matching against brute force, and search rules."""

import itertools

import pytest

from conftest import FINDING, HOST, PORT, TAG, VULN
from exposure.inventory import Inventory
from exposure.operators import search, vulns

CPES = [
    "cpe:/a:apache:http:2.4", "cpe:/a:apache:http", "cpe:/o:linux:linux_kernel", "cpe:2.3:a:apache:http:2.4:*", "cpe:2.3:a:apache:http", "cpe:2.3:a",
    "cpe:2.3:a:nginx:nginx:1.0:*", "cpe:2.3:a:apache:http_server:2.4:*", "nocolon", "cpe:/a:nginx:nginx:1.0",
]
DB = [
    ("cpe:2.3:a:apache:http:2.4:*", ["C1", "C2", "C2"]), ("cpe:2.3:a:apache:http:2.5:*", ["C1", "C3"]), ("cpe:2.3:a:apache:http_server:2.4:*", ["C1", "C4"]),
    ("cpe:/a:apache:http:2.4", ["C5"]), ("cpe:/o:linux:linux_kernel:5.1", ["C6"]), ("cpe:2.3:a:nginx:nginx:1.0:*", ["C1", "C7"]), ("nocolon:x", ["C8"]),
]


def parts(cpe):
    return cpe.replace("cpe:/", "cpe:2.3:", 1).split(":") if cpe.startswith("cpe:/") else cpe.split(":")


def related(cpe, key, mode):
    """None, or 0 for an exact and 1 for a prefix match."""
    if mode == "literal":
        return (0 if key == cpe else 1) if key.startswith(":".join(cpe.split(":")[:5])) else None
    a, b = parts(cpe), parts(key)
    if len(a) < 5 or len(b) < 5 or a[:5] != b[:5]:
        return None
    version = lambda p: p[5] if len(p) > 5 and p[5] not in ("", "*", "-") else None
    return 0 if cpe == key or version(a) == version(b) else 1


def brute(ports, mode):
    best = {}
    for p in ports:
        for key, cves in DB:
            rank = related(p["cpe"], key, mode) if p["state"] == "open" and p["cpe"] else None
            for n, cve in enumerate(cves):
                if rank is not None:
                    entry = (p["port"], rank, key, n)
                    best[(p["ip"], cve)] = min(best.get((p["ip"], cve), entry), entry)
    return {k: (v[0], v[1], v[2]) for k, v in best.items()}


@pytest.fixture(scope="module")
def db(rows):
    data = [{"cpe": cpe, "ord": n, "cve": cve, "cvss": 5.0, "descr": f"{cpe}/{n}"} for cpe, cves in DB for n, cve in enumerate(cves)]
    return rows(data, VULN)


@pytest.mark.parametrize("mode", ["literal", "normalized"])
def test_first_match_per_cve_equals_brute_force(rows, db, mode):
    ports = [{"scan_id": 1, "ip": "one", "port": n, "proto": "tcp", "state": "open", "cpe": c} for n, c in enumerate(CPES)]
    for a, b in itertools.permutations(CPES, 2):
        host = f"{a}|{b}"
        ports += [{"scan_id": 1, "ip": host, "port": 7, "proto": "tcp", "state": "open", "cpe": a}, {"scan_id": 1, "ip": host, "port": 7, "proto": "udp", "state": "open", "cpe": b}]
    ports.append({"scan_id": 1, "ip": "shut", "port": 1, "proto": "tcp", "state": "closed", "cpe": CPES[0]})
    got = {(r.ip, r.cve): (r.port, 0 if r.match == "exact" else 1, r.cpe) for r in vulns.match_cves(rows(ports, PORT), db, mode).collect()}
    assert got == brute(ports, mode)


def test_prefix_join_plans_no_nested_loop(rows, db):
    ports = rows([{"scan_id": 1, "ip": "x", "port": 1, "proto": "tcp", "state": "open", "cpe": CPES[0]}], PORT)
    for mode in ("literal", "normalized"):
        plan = vulns.match_cves(ports, db, mode)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_literal_rows_that_occur_once_on_a_host_are_not_regrouped(rows, db, plan_of):
    """all pairs of hosts and CVEs used to be shuffled to find the first of each."""
    cpes = [*CPES, "cpe:2.3:a:apache:htt", "cpe:2.3:a:apache:httq:1", "a", "ab", "a\uffff", "a\U0010ffffb"]
    ports = [{"scan_id": 1, "ip": "all", "port": n, "proto": "tcp", "state": "open", "cpe": c} for n, c in enumerate(cpes)]
    for a, b in itertools.permutations(cpes, 2):
        ports += [{"scan_id": 1, "ip": f"{a}|{b}", "port": n, "proto": "tcp", "state": "open", "cpe": c} for n, c in enumerate((a, b))]
    base, on_host = lambda c: ":".join(c.split(":")[:5]), {}
    for p in ports:
        on_host.setdefault(p["ip"], []).append(p["cpe"])
    want = {(ip, c): not any(o != c and (base(o).startswith(base(c)) or base(c).startswith(base(o))) for o in own) for ip, own in on_host.items() for c in own}
    table = rows(ports, PORT)
    assert {(r.ip, r.cpe): r.apart for r in vulns._apart(vulns._open_cpes(table)).collect()} == want
    assert {(r.ip, r.cve): r.cpe for r in vulns.match_cves(table, db, "literal").collect()} == {k: v[2] for k, v in brute(ports, "literal").items()}
    assert "Union" in plan_of(vulns.match_cves(table, db, "literal"))


def test_severity_only_database_keeps_empty_cpes_in_the_count(rows):
    data = [{"cpe": "a", "ord": 0, "cve": "C1"}, {"cpe": "b", "ord": None, "cve": None}, {"cpe": "c", "ord": 0, "cve": "C1"}]
    stats = vulns.vuln_db_stats(rows(data, VULN)).first()
    assert (stats.cpes, stats.mappings, stats.unique_cves) == (3, 2, 1)


@pytest.fixture(scope="module")
def inventory(rows, db):
    host = lambda ip, **kw: {"scan_id": 1, "ip": ip, "status": "up", **kw}
    port = lambda ip, n, **kw: {"scan_id": 1, "ip": ip, "port": n, "proto": "tcp", "state": "open", **kw}
    hosts = [host("10.0.0.1", hostname="web_1", mac="aa:bb", os_name="Linux 5"), host("10.0.0.2", hostname="webx1", os_name="Windows"), host("10.0.0.3", status="down")]
    ports = [port("10.0.0.1", 22, svc="ssh", product="OpenSSH"), port("10.0.0.2", 2222, svc="ssh"), port("10.0.0.2", 2375), port("10.0.0.3", 22, state="closed", product="gone")]
    tags = [{"asset_key": "mac:AA:BB", "labels": ["crown"], "owner": "ann"}, {"asset_key": "10.0.0.2", "labels": ["p1"]}]
    findings = [{"scan_id": 1, "ip": "10.0.0.3", "finding_ord": 1, "plugin_id": 1, "severity": 4, "exploit_available": False, "cves": ["CVE-2024-1"], "port": 1}]
    return Inventory(hosts=rows(hosts, HOST), ports=rows(ports, PORT), findings=rows(findings, FINDING), tags=rows(tags, TAG), vuln_db=db)


@pytest.mark.parametrize(
    "terms, want",
    [
        ([("port", "22")], "12"), ([("port", "22-23")], "1"), ([("port", "2*5")], "2"), ([("svc", "SS*")], "12"), ([("product", "GONE")], "3"),
        ([("host", "web_*")], "1"), ([("host", "web")], "12"), ([("os", "windows")], "2"), ([("mac", "AA")], "1"), ([("tag", "crown")], "1"),
        ([("label", "p*")], "2"), ([("owner", "ANN")], "1"), ([("cve", "cve-2024-*")], "3"), ([("admin", "yes")], "2"), ([("admin", "docker")], "2"),
        ([("risk", ">20")], "3"), ([("risk", "<20")], "12"), ([("risk", "25")], "3"), ([("text", "22 ssh openssh linux")], "1"), ([("nonsense", "2375")], "2"),
        ([], "123"), ([("svc", "ssh"), ("os", "linux")], "1"), ([("ip", "10.0.0.*")], "123"), ([("text", "*web_1*")], "1"),
    ],
)
def test_search_terms(inventory, terms, want):
    assert "".join(sorted(r.ip[-1] for r in search.search(inventory, terms).collect())) == want


def test_visibility_counts_up_hosts(inventory):
    row = search.visibility(inventory, [("svc", "ssh")], "tagged").first()
    assert (row.visible, row.total) == (2, 2)


def test_literal_prefixes_meet_by_equality(rows):
    """One vendor holds a third of the database; one product name begins another; no vendor-wide join and no nested loop."""
    names = [f"cpe:2.3:a:big:prod{i}:{i % 3}:*" for i in range(200)] + [f"cpe:2.3:a:v{i}:p:{i}:*" for i in range(400)]
    db = rows([{"cpe": c, "ord": 0, "cve": "C"} for c in names], VULN)
    cpes = ["cpe:2.3:a:big:prod1:9:*", "cpe:2.3:a:big:prod19", "cpe:2.3:a:big", "cpe:2.3:a:v7:p:7:*", "cpe:/a:big:prod1"]
    pairs = vulns.cpe_pairs(rows([{"cpe": c} for c in cpes], "cpe string"), db, "literal")
    want = {(c, n) for c in cpes for n in names if n.startswith(":".join(c.split(":")[:5]))}
    assert {(r.cpe, r.db_cpe) for r in pairs.collect()} == want and ("cpe:2.3:a:big:prod1:9:*", "cpe:2.3:a:big:prod10:1:*") in want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan and "StartsWith" not in plan and "slice(split" in plan
    assert "stem" not in plan


def shared_catalogue(seed):
    """Ports and a database in which CVEs are listed under several products and ports report several CPEs of one."""
    import random

    rng = random.Random(seed)
    product = lambda: f"cpe:2.3:a:v{rng.randrange(2)}:p{rng.randrange(5)}:{rng.choice(['1', '2', '*'])}"
    ports = [{"scan_id": rng.randrange(2), "ip": f"h{rng.randrange(6)}", "port": rng.choice([22, 80]), "proto": rng.choice(["tcp", "udp"]), "state": rng.choice(["open", "open", "closed"]), "cpe": rng.choice([None, "cpe:/a:x", product(), product()])} for _ in range(60)]
    db = [{"cpe": product() + ":*", "ord": i, "cve": rng.choice([None, "", f"CVE-{rng.randrange(25)}"]), "cvss": float(rng.randrange(4)), "descr": "d"} for i in range(70)]
    return ports, db


@pytest.mark.parametrize("seed", range(4))
def test_counts_existence_and_top_equal_the_whole_match(rows, seed):
    from conftest import HOST, PORT
    from exposure.operators import postings, topk
    from pyspark.sql import functions as F

    data, listed = shared_catalogue(seed)
    ports, db = rows(data, PORT), rows(listed, VULN)
    whole = vulns.match_cves(ports, db)
    lines = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert lines(vulns.count_cves(ports, db)) == lines(whole.groupBy("scan_id", "ip").agg(F.count("*").alias("cves")))
    assert lines(vulns.hosts_matching(ports, db)) == lines(whole.select("scan_id", "ip").distinct())
    columns = ["scan_id", "ip", "cve", "cvss", "port", "rank", "more"]
    preview = topk.preview(whole, ["scan_id", "ip"], [F.desc("cvss"), F.asc("cve")], 3)
    assert lines(vulns.top_cves(ports, db, 3).select(*columns)) == lines(preview.select(*columns))
    hosts = rows([{"scan_id": s, "ip": f"h{i}", "status": "up" if i else "down", "os_name": "Linux box"} for s in range(2) for i in range(6)], HOST)
    found = rows([{"scan_id": 0, "ip": f"h{i}", "finding_ord": i, "plugin_id": i, "plugin_name": "n", "severity": 1, "cves": [f"cve-{i * 3}", f"CVE-{i}", "CVE-x"]} for i in range(6)], FINDING)
    for findings in (found, None):
        inv = Inventory(hosts=hosts, ports=ports, findings=findings, vuln_db=db)
        assert lines(postings.key_counts(inv)) == lines(postings.posting_counts(postings.postings(inv)))


def test_counting_cves_meets_classes_and_not_cves(rows):
    """Two thousand CVEs of one product are one class: a host joins one row."""
    from conftest import PORT

    db = rows([{"cpe": "cpe:2.3:a:big:p:1:*", "ord": i, "cve": f"CVE-{i}"} for i in range(2000)] + [{"cpe": "cpe:2.3:a:big:q:1:*", "ord": 0, "cve": "CVE-7"}], VULN)
    assert sorted((r.stem, r["class"], r.cves) for r in vulns.class_products(db).collect()) == [("cpe:2.3:a:big:p", "CVE-0", 1999), ("cpe:2.3:a:big:p", "CVE-7", 1), ("cpe:2.3:a:big:q", "CVE-7", 1)]
    ports = rows([{"scan_id": 1, "ip": f"h{i}", "port": 80, "proto": "tcp", "state": "open", "cpe": c} for i in range(3) for c in ("cpe:/a:big:p:1", "cpe:/a:big:q:2")], PORT)
    assert {r.cves for r in vulns.count_cves(ports, db).collect()} == {2000}


def test_literal_prefixes_are_joined_by_sorting(spark, rows, tmp_path, plan_of):
    """The database cut to all lengths is many times its file, by whose size it would be broadcast."""
    for name, data, schema in (("cpes", [{"cpe": c} for c in CPES], "cpe string"), ("db", [{"cpe": c, "ord": 0, "cve": v} for c, vs in DB for v in vs], VULN)):
        rows(data, schema).write.parquet(str(tmp_path / name))
    cpes, db = (spark.read.parquet(str(tmp_path / n)) for n in ("cpes", "db"))
    pairs = vulns.cpe_pairs(cpes, db, "literal")
    assert "SortMergeJoin" in plan_of(pairs) and "BroadcastHashJoin" not in plan_of(pairs)
    assert {tuple(r) for r in pairs.select("cpe", "db_cpe").collect()} == {(c, k) for c in CPES for k, _ in DB if related(c, k, "literal") is not None}


def test_postings_are_told_apart_by_host(rows, plan_of):
    """Repeated and null keys of several tables give one posting each, and no aggregation holds a row for every posting."""
    import re

    from conftest import HOST, PORT, TAG
    from exposure.operators import postings

    up = {"scan_id": 1, "ip": "a", "mac": None, "status": "up"}
    hosts = rows([{**up, "os_name": "Linux 4.15 linux"}, {**up, "os_name": "Linux BSD"}, {**up, "ip": None, "os_name": "BSD"}, {**up, "ip": "b", "os_name": None}, {**up, "ip": "c", "status": "down", "os_name": "Linux"}], HOST)
    port = {"scan_id": 1, "ip": "a", "port": 80, "state": "open", "cpe": "cpe:/a:v:p"}
    ports = rows([{**port, "proto": "tcp", "svc": "HTTP", "product": "Nginx"}, {**port, "proto": "udp", "svc": "http", "product": ""}, {**port, "ip": "c"}, {**port, "ip": "b", "port": None, "svc": None, "cpe": None}, {**port, "ip": "b", "state": "closed"}], PORT)
    finding = {"scan_id": 1, "ip": "a", "plugin_id": 1, "severity": 1}
    findings = rows([{**finding, "plugin_name": "nginx", "cves": ["cve-1", None, "CVE-9"]}, {**finding, "plugin_name": "NGINX", "cves": ["CVE-9", ""]}, {**finding, "plugin_name": None, "cves": None}, {**finding, "ip": None, "plugin_name": "x", "cves": ["CVE-7"]}], FINDING)
    tags = rows([{"asset_key": "ip:a", "labels": ["p1", None, "p1", ""]}, {"asset_key": "ip:b", "labels": None}], TAG)
    db = rows([{"cpe": "cpe:2.3:a:v:p:1:*", "ord": 1, "cve": "CVE-1", "cvss": 1.0, "descr": "d"}, {"cpe": "cpe:2.3:a:v:p:1:*", "ord": 2, "cve": "CVE-2", "cvss": 1.0, "descr": "d"}], VULN)
    found = postings.postings(Inventory(hosts=hosts, ports=ports, findings=findings, tags=tags, vuln_db=db))
    want = [("port", "80"), ("service", "http"), ("product", "nginx"), ("os", "linux"), ("os", "4.15"), ("os", "bsd"), ("tag", "p1"), ("cve", "cve-1"), ("cve", "cve-2"), ("cve", "cve-9")]
    assert found.columns == ["scan_id", "kind", "key", "ip"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, *w, "a") for w in want] + [(1, "os", "bsd", None)]))
    assert not re.search(r"Aggregate\(keys=\[[^\]]*\bkind#[^\]]*\bkey#", plan_of(found))
