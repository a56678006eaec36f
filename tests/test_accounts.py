"""Rejected elements, values that are no numbers, and places in an order."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import FINDING
from exposure.operators import topk
from exposure.sources import accounts, elements, nessus, nmap

HOST = '<host><status state="up"/><address addr="{}" addrtype="ipv4"/><ports><port protocol="tcp" portid="{}"><state state="open"/></port></ports></host>'
GOOD = HOST.format("10.0.0.1", 22)


@pytest.fixture(scope="module")
def reports(tmp_path_factory):
    folder = tmp_path_factory.mktemp("reports")
    (folder / "whole.xml").write_text(f"<nmaprun>{GOOD}{HOST.format('10.0.0.2', 'abc')}</nmaprun>")
    (folder / "mixed.xml").write_text(f"<nmaprun>{GOOD}<host><status></host><host><status state='up'/></host>{HOST.format('10.0.0.3', ' ')}</nmaprun>")
    (folder / "cut.xml").write_text(f"<nmaprun>{GOOD}{GOOD[:90]}")
    (folder / "empty.xml").write_text("<nmaprun></nmaprun>")
    return str(folder)


def by_file(rows, *columns):
    return sorted((r.scan_id.rsplit("/", 1)[1], *[r[c] for c in columns]) for r in rows)


def test_every_element_is_a_row_or_a_reject(spark, reports):
    records = elements.read_records(spark, reports, "</host>")
    checked, seen = accounts.observed(accounts.checked(records, "nmap"), "nmap")
    rows = checked.collect()
    assert seen.get == {"elements": 8, "rows": 5, "malformed": 2, "without_address": 1}
    assert len(rows) == seen.get["rows"] + seen.get["malformed"] + seen.get["without_address"]
    left = accounts.rejects(accounts.checked(records, "nmap")).collect()
    assert by_file(left, "reason") == [("cut.xml", "malformed"), ("mixed.xml", "malformed"), ("mixed.xml", "no address")]
    assert any(r.text == "<host><status></host>" for r in left) and all(r.host_ord is not None for r in left)
    per_report = accounts.report_accounts(accounts.checked(records, "nmap")).collect()
    assert by_file(per_report, "elements", "rows", "malformed", "without_address") == [("cut.xml", 2, 1, 1, 0), ("mixed.xml", 4, 2, 1, 1), ("whole.xml", 2, 2, 0, 0)]


def test_accepted_hosts_are_those_of_the_reader(spark, reports):
    records = elements.read_records(spark, reports, "</host>")
    ours = accounts.accepted(accounts.checked(records, "nmap"))
    assert ours.schema == nmap.from_records(records).schema
    assert by_file(ours.collect(), "ip") == by_file(nmap.from_records(records).collect(), "ip")


def test_bad_numbers_and_unfinished_reports(spark, reports):
    records = elements.read_records(spark, reports, "</host>")
    bad = accounts.bad_numbers(nmap.from_records(records), "nmap").collect()
    assert by_file(bad, "ip", "field", "value") == [("whole.xml", "10.0.0.2", "port", "abc")]
    assert by_file(accounts.unfinished(records, "nmap").collect()) == [("cut.xml",)]


def test_nessus_accounts(spark, tmp_path):
    item = '<ReportItem port="{}" protocol="tcp" severity="{}" pluginID="7"><cvss_base_score>{}</cvss_base_score></ReportItem>'
    (tmp_path / "r.nessus").write_text(
        f'<NessusClientData_v2><Report name="r"><ReportHost name="h1">{item.format(1, "high", "9.8")}{item.format("x", 2, "n/a")}</ReportHost>'
        f'<ReportHost name="">{item.format(1, 2, 3)}</ReportHost><ReportHost name="h3"><ReportItem></ReportHost></Report></NessusClientData_v2>'
    )
    records = elements.read_records(spark, str(tmp_path), "</ReportHost>")
    checked = accounts.checked(records, "nessus")
    assert sorted(r.reason for r in accounts.rejects(checked).collect()) == ["malformed", "no address"]
    assert accounts.accepted(checked).schema == nessus.from_records(records).schema
    bad = accounts.bad_numbers(accounts.accepted(checked), "nessus").collect()
    assert sorted((r.ip, r.field, r.value) for r in bad) == [("h1", "cvss", "n/a"), ("h1", "port", "x"), ("h1", "severity", "high")]
    assert accounts.unfinished(records, "nessus").count() == 0


def test_places_follow_the_order_whatever_the_partitions(spark, rows, tmp_path):
    data = [{"scan_id": i % 2, "ip": "hot" if i % 3 else f"h{i % 7}", "finding_ord": i, "severity": random.Random(i).randrange(3), "cvss3": [None, 1.0, 9.0][i % 3], "cvss": 2.0} for i in range(500)]
    findings = rows(data, FINDING).repartition(5)
    got = topk.place_findings(findings, str(tmp_path / "a")).collect()
    score = lambda r: r["cvss3"] if r["cvss3"] is not None else r["cvss"]
    for key in {(d["scan_id"], d["ip"]) for d in data}:
        want = [d["finding_ord"] for d in sorted((d for d in data if (d["scan_id"], d["ip"]) == key), key=lambda d: (-d["severity"], -score(d), d["finding_ord"]))]
        assert [r.finding_ord for r in sorted((r for r in got if (r.scan_id, r.ip) == key), key=lambda r: r.place)] == want
        assert sorted(r.place for r in got if (r.scan_id, r.ip) == key) == list(range(1, len(want) + 1))
    every = topk.placed(findings, [F.desc("severity"), F.asc("finding_ord")], str(tmp_path / "b")).collect()
    assert [r.finding_ord for r in sorted(every, key=lambda r: r.place)] == [d["finding_ord"] for d in sorted(data, key=lambda d: (-d["severity"], d["finding_ord"]))]
    none = topk.placed(findings.where("false"), [F.asc("finding_ord")], str(tmp_path / "c"))
    assert none.collect() == [] and none.columns[-1] == "place"
