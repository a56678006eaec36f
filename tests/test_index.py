"""Search through the stored index against the search over the tables."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import FINDING, HOST, PORT, TAG, VULN
from exposure.inventory import Inventory
from exposure.operators import index, search

TERMS = [
    ("port", "4"), ("port", "443"), ("port", "1-100"), ("port", "*"), ("port", "9-1"), ("svc", "HTTP*"), ("service", "ssh"), ("product", "open*d"),
    ("product", "%"), ("product", "_"), ("os", "linux"), ("os", ""), ("ip", "10.0.0.1"), ("ip", "*.1"), ("host", "a"), ("mac", "AA:"), ("tag", "crit"), ("label", "c*l"),
    ("owner", "Bob"), ("cve", "cve-2024-1"), ("cve", "2024-7"), ("cve", "nothing here"), ("admin", "true"), ("admin", "ssh"), ("admin", "remote"), ("risk", ">1"), ("risk", "x"),
    ("text", "22 ssh"), ("text", "*ssh*linux*"), ("text", "*"), ("text", ""), ("text", " "), ("nofield", "web"), ("text", "q" * 5000),
]


@pytest.fixture(scope="module")
def inv(rows):
    hosts, ports = [], []
    for n in range(60):
        ip = f"10.0.0.{n}"
        hosts.append({"scan_id": 1 + n % 2, "ip": ip, "status": "up" if n % 5 else "down", "mac": f"AA:BB:{n:02d}" if n % 3 else None, "hostname": [None, "", "web a", f"db{n}"][n % 4],
                      "os_name": [None, "Linux 5", "Windows 10", ""][n % 4 if n % 7 else 1]})
        for k, (port, state, svc, product, cpe) in enumerate([
            (22, "open", "ssh", "OpenSSH_d", "cpe:/a:openbsd:ssh:9"), (443, "open" if n % 2 else "closed", "HTTPS", "100% web", "cpe:/a:apache:http:2"), (80 + n, "open", "http", None, None),
        ]):
            if (n + k) % 3:
                ports.append({"scan_id": 1 + n % 2, "ip": ip, "port": port, "proto": "tcp", "state": state, "svc": svc, "product": product, "cpe": cpe})
                if n % 8 == 0:  # rows that repeat
                    ports.append({**ports[-1], "proto": "udp"})
    hosts.append({"scan_id": 1, "ip": "bare"})
    findings = [{"scan_id": 1 + n % 2, "ip": f"10.0.0.{n}", "finding_ord": n, "severity": n % 5, "cves": [[], None, ["CVE-2024-7"], ["CVE-2024-7", "cve-2024-8"]][n % 4]} for n in range(0, 60, 3)]
    tags = [{"asset_key": f"mac:AA:BB:{n:02d}", "labels": ["critical", "x"], "owner": "bob"} for n in range(0, 30, 4)] + [{"asset_key": "10.0.0.3", "labels": None, "owner": "Bobby"}]
    db = [{"cpe": "cpe:2.3:a:apache:http:2:*", "ord": 0, "cve": "CVE-2024-1", "cvss": 5.0}, {"cpe": "cpe:2.3:a:openbsd:ssh:8:*", "ord": 1, "cve": "CVE-2024-11", "cvss": 5.0},
          {"cpe": "cpe:2.3:a:nobody:has:8:*", "ord": 2, "cve": "CVE-2024-1", "cvss": 5.0}]
    return Inventory(hosts=rows(hosts, HOST), ports=rows(ports, PORT), findings=rows(findings, FINDING), tags=rows(tags, TAG), vuln_db=rows(db, VULN))


@pytest.fixture(scope="module")
def built(inv, tmp_path_factory):
    return index.build(inv, str(tmp_path_factory.mktemp("index") / "i"), per_block=8)


def found(df):
    return sorted((r.scan_id, r.ip) for r in df.select("scan_id", "ip").collect())


@pytest.mark.parametrize("term", TERMS, ids=lambda t: f"{t[0]}={t[1][:12]}")
def test_each_term_finds_what_the_scan_finds(inv, built, term):
    assert found(index.search(inv, built, [term])) == found(search.search(inv, [term]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(terms=st.lists(st.sampled_from(TERMS), max_size=4))
def test_conjunctions(inv, built, terms):
    assert found(index.search(inv, built, terms)) == found(search.search(inv, terms))


@pytest.mark.parametrize("value", ["2", "ssh", "HTTPS", "*b*", "linux", "", "zzz"])
def test_quick_search(inv, built, value):
    assert found(index.quick_search(inv, built, value)) == found(search.quick_search(inv, value))


def test_more_keys_than_are_listed_are_joined(inv, built, monkeypatch):
    monkeypatch.setattr(index, "LISTED", 2)
    for terms in ([("port", "8"), ("ip", "1")], [("text", "1")]):
        assert index.resolve(built, *terms[0]).listed is None
        assert found(index.search(inv, built, terms)) == found(search.search(inv, terms))


def test_an_empty_inventory(inv, tmp_path):
    none = Inventory(hosts=inv.hosts.where("false"), ports=inv.ports.where("false"))
    empty = index.build(none, str(tmp_path / "i"))
    assert found(index.search(none, empty, [("port", "22"), ("text", "a")])) == [] == found(index.quick_search(none, empty, "abc"))


def test_blocks_are_sorted_small_and_whole(inv, built):
    rows = built.blocks.collect()
    assert all(r.n == len(r.hosts) and list(r.hosts) == sorted(r.hosts) and r.first == r.hosts[0] and r.last == r.hosts[-1] for r in rows)
    assert len({r.block for r in rows}) > 4 and max(r.n for r in rows) < 30  # 61 hosts in blocks of about 8
    open_22 = inv.ports.where("state = 'open' AND port = 22").select("scan_id", "ip").distinct().count()
    assert sum(r.n for r in rows if (r.kind, r.key) == ("port", "22")) == open_22


def test_a_search_reads_only_the_blocks_of_its_keys(inv, built):
    keys = index.resolve(built, "port", "443")
    assert keys.listed == [("port", "443")]
    blocks = index.blocks_of(built, keys)
    text = blocks._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "kind#" in scan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(key,443)" in scan
    assert {(r.kind, r.key) for r in blocks.collect()} == {("port", "443")}
    whole = index.search(inv, built, [("port", "443"), ("os", "linux")])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in whole.splitlines() if "FileScan parquet" in line]
    assert scans and all("(key," in s.split("PushedFilters: ")[1] for s in scans)  # the hosts of the fixture are not files


def test_substrings_are_looked_up_by_their_rarest_three_letters(built):
    of = lambda part: index.candidates(built, ("ip",), part).count()
    everyone = built.terms.where("kind = 'ip'").count()
    assert of("10") == everyone and of("0.0.5") == everyone - built.terms.where("kind = 'ip' AND NOT contains(key, '0.5')").count()
    assert of("no such") == 0 and index.longest_part("a*LONG one*b") == "long one"
    counted = built.gram_counts.where("kind = 'ip' AND gram = '0.5'").first().terms
    assert counted == built.terms.where(F.col("kind") == "ip").where(F.col("key").contains("0.5")).count() == of("0.0.5")


def test_a_cve_stands_for_products(built):
    """No posting of a host and a CVE that only the database knows."""
    assert index.resolve(built, "cve", "cve-2024-11").listed == [("cpe", "cpe:2.3:a:openbsd:ssh")]
    assert built.blocks.where("kind = 'cve' AND key = 'cve-2024-11'").count() == 0


def test_blocks_of_popular_keys_are_dealt_to_many_tasks(spark):
    """Ranges are drawn by size, not by blocks: here 20 blocks side by side have most of the hosts."""
    popular = spark.range(20 * 400).selectExpr("'port' AS kind", "'22' AS key", "int(id % 20) AS block", "struct(int(id % 3) AS scan_id, lpad(id, 6, '0') AS ip) AS h")
    others = spark.range(500).selectExpr("'ip' AS kind", "lpad(id, 6, '0') AS key", "int(id % 20) AS block", "struct(1 AS scan_id, lpad(id, 6, '0') AS ip) AS h")
    lists = popular.unionByName(others).groupBy("kind", "key", "block").agg(F.array_sort(F.collect_set("h")).alias("hosts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = index.in_key_order(lists)
        sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.size("hosts")).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 8500 and max(sizes) < 5000
    assert same_lists(dealt, lists)


def same_lists(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
