"""Readers and writers on small hand-written files."""

import csv
import glob
import json

import pytest

from conftest import HOST, PORT, VULN
from exposure.functions import scripts as S
from exposure.operators import scripts as script_ops
from exposure.sinks import exports
from exposure.sources import accounts, detect, nessus, nmap, tags, vulndb
from pyspark.sql import functions as F

HOST_A = """<host starttime="1" endtime="2"><status state="up" reason="arp"/>
<address addr="fe80::1" addrtype="ipv6"/><address addr="192.0.2.1" addrtype="ipv4"/><address addr="aa:bb:cc:00:00:01" addrtype="mac" vendor="Maker &amp; Sons"/>
<hostnames><hostname name="alpha" type="PTR"/><hostname name="beta"/></hostnames>
<ports><extraports state="closed" count="9"/>
<port protocol="tcp" portid="22"><state state="open"/><service name="ssh" product="OpenSSH" version="9" servicefp="SF-Port22-TCP:V=7%r(NULL,1)"><cpe>cpe:/a:openbsd:openssh:9</cpe><cpe>cpe:/o:linux:linux_kernel</cpe></service>
<script id="ssh-hostkey" output="&#xa;  256 ab:cd (ED25519)&#xa;  3072 ssh-rsa 0123456789abcdefXYZ"/></port>
<port protocol="udp" portid="161"><state state="filtered"/></port></ports>
<os><osmatch name="Linux 5" accuracy="96"/><osmatch name="Linux 4" accuracy="90"/><osfingerprint fingerprint="SCAN(V=7.95%E=4)&#xa;SEQ(SP=1%TI=Z)"/></os>
<hostscript><script id="ssl-cert" output="Subject: commonName=a.example/organizationName=A&#xa;Issuer: commonName=ca&#xa;Not valid after:  2030-01-02T00:00:00"/></hostscript>
<trace><hop ttl="1" ipaddr="192.0.2.254" rtt="--" host="gw"/><hop ttl="2" ipaddr="192.0.2.1" rtt="1.50"/></trace></host>"""
HOST_B = '<host><status state="down"/><address addr="2001:db8::5" addrtype="ipv6"/><hostnames>\n</hostnames></host>'
HOST_C = '<host><status state="up"/><address addr="00:11:22:33:44:55" addrtype="mac"/></host>'
HEAD = '<?xml version="1.0"?>\n<!DOCTYPE nmaprun>\n<nmaprun scanner="nmap" args="nmap &gt; &quot;x&quot;" start="1700000000" startstr="Tue" version="7.95">\n<hosthint><status state="up"/><address addr="192.0.2.99" addrtype="ipv4"/></hosthint>\n'
STATS = '<runstats><finished time="1" timestr="Wed"/><hosts up="7" down="3" total="10"/></runstats>\n</nmaprun>\n'


@pytest.fixture(scope="module")
def nmap_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("nmap")
    (folder / "one.xml").write_text(HEAD + "\n".join([HOST_A, HOST_B, HOST_C]) + STATS)
    (folder / "two.xml").write_text(HEAD.replace("nmap &gt; &quot;x&quot;", "") + HOST_B + "</nmaprun>")
    return str(folder)


def test_nmap_tables(spark, nmap_dir):
    nested = nmap.read(spark, f"{nmap_dir}/one.xml").persist()
    hosts = {r.ip: r for r in nmap.hosts(nested).collect()}
    assert set(hosts) == {"192.0.2.1", "2001:db8::5"}
    a, b = hosts["192.0.2.1"], hosts["2001:db8::5"]
    assert (a.mac, a.mac_vendor, a.hostname, a.status, a.os_name, a.os_accuracy) == ("aa:bb:cc:00:00:01", "Maker & Sons", "alpha", "up", "Linux 5", 96)
    assert a.cpes == ["cpe:/a:openbsd:openssh:9", "cpe:/o:linux:linux_kernel"] and len(a.os) == 2 and "\n" in a.os_fingerprint
    assert (b.mac, b.hostname, b.status, b.os_name, b.os, b.cpes) == (None, None, "down", None, [], [])
    ports = [(r.port, r.proto, r.state, r.svc, r["product"], r.cpe) for r in nmap.ports(nested).orderBy("port_ord").collect()]
    assert ports == [(22, "tcp", "open", "ssh", "OpenSSH", "cpe:/a:openbsd:openssh:9"), (161, "udp", "filtered", None, None, None)]
    trace = [(r.ttl, r.hop_ip, r.hop_host, r.rtt) for r in nmap.trace(nested).orderBy("hop_ord").collect()]
    assert trace == [(1, "192.0.2.254", "gw", None), (2, "192.0.2.1", None, 1.5)]
    found = {r.script_id: r for r in script_ops.script_findings(nmap.scripts(nested)).collect()}
    cert = found["ssl-cert"]
    assert (cert.subject, cert.issuer, cert.expires, cert.port) == ("commonName=a.example/organizationName=A", "commonName=ca", "2030-01-02", None)
    key = found["ssh-hostkey"]
    assert key.port == 22 and [tuple(k) for k in key["keys"]] == [("256", "ab", "cd..."), ("3072", "ssh-rsa", "0123456789abcdef...")] or key["keys"]
    fields = {(r.section, r.key): r.value for r in script_ops.os_fingerprint_fields(nmap.hosts(nested)).collect()}
    assert fields == {("SCAN", "V"): "7.95", ("SCAN", "E"): "4", ("SEQ", "SP"): "1", ("SEQ", "TI"): "Z"}
    response = script_ops.service_fingerprints(nmap.ports(nested)).first().response
    assert response == "Port22-TCP:V=7%r(NULL,1)"


def test_a_report_is_split_over_tasks_without_changing_the_result(spark, nmap_dir, tmp_path):
    big = HEAD + "".join(HOST_A.replace("192.0.2.1\"", f"192.0.{i}.1\"") for i in range(60)) + STATS
    (tmp_path / "big.xml").write_text(big)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        nested = nmap.read(spark, str(tmp_path))
        assert nested.rdd.getNumPartitions() > 3
        rows = nmap.hosts(nested).orderBy("host_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.ip for r in rows] == [f"192.0.{i}.1" for i in range(60)]


def test_nmap_runs(spark, nmap_dir):
    from exposure.sources.elements import read_records

    records = read_records(spark, nmap_dir, "</host>")
    runs = {r.scan_id.rsplit("/", 1)[1]: r for r in nmap.runs(records, nmap.from_records(records)).collect()}
    one, two = runs["one.xml"], runs["two.xml"]
    assert (one.args, one.version, one.started_str, one.finished_str, one.total, one.up, one.down) == ('nmap > "x"', "7.95", "Tue", "Wed", 10, 7, 3)
    assert (two.source_name, two.args, two.finished_str, two.total, two.up, two.down) == ("Nmap Scan", None, None, 1, 0, 0)


ITEM = '<ReportItem port="{port}" svc_name="{svc}" protocol="{proto}" severity="{sev}" pluginID="{pid}" pluginName="P{pid}">{body}</ReportItem>'


def nessus_text():
    items = [
        ITEM.format(port=443, svc="?", proto="tcp", sev=0, pid=1, body=""),
        ITEM.format(port=443, svc="www", proto="tcp", sev=3, pid=2, body="<cvss3_base_score>7.5</cvss3_base_score><cvss_base_score>bad</cvss_base_score><vpr_score>0</vpr_score><cve>CVE-1</cve><cve>CVE-2</cve><exploit_available>true</exploit_available><cpe>cpe:/a:x</cpe><plugin_output>a\n &lt;b&gt;</plugin_output>"),
        ITEM.format(port=0, svc="general", proto="tcp", sev=4, pid=3, body="<exploit_available>TRUE</exploit_available>"),
        ITEM.format(port=53, svc="dns", proto="udp", sev="x", pid=4, body=""),
    ]
    tag = lambda n, v: f'<tag name="{n}">{v}</tag>'
    props = [tag("host-ip", "192.0.2.7"), tag("netbios-name", "NB"), tag("operating-system", "Windows"), tag("cpe-1", "c1"), tag("cpe", "c0"), tag("cpe", "c1"), tag("cpe-x", "no"), tag("traceroute-hop-1", "b"), tag("traceroute-hop-0", "a"), tag("Credentialed_Scan", "true")]
    host = f'<ReportHost name="n1"><HostProperties>{"".join(props)}</HostProperties>{"".join(items)}</ReportHost>'
    other = '<ReportHost name="192.0.2.8"><HostProperties></HostProperties></ReportHost>'
    return f'<?xml version="1.0" ?>\n<NessusClientData_v2>\n<Report name="weekly" xmlns:cm="x">{host}\n</Report><Report name="second">{other}</Report>\n</NessusClientData_v2>\n'


def test_nessus_tables(spark, tmp_path):
    from exposure.sources.elements import read_records

    (tmp_path / "r.nessus").write_text(nessus_text())
    nested = nessus.read(spark, str(tmp_path)).persist()
    web = {r.ip: r for r in nessus.hosts(nested).collect()}
    desktop = {r.ip: r for r in nessus.hosts(nested, "desktop").collect()}
    a = web["192.0.2.7"]
    assert set(web) == {"192.0.2.7", "192.0.2.8"}
    assert (a.hostname, a.os_name, a.os_accuracy, a.cpes, a.credentialed_scan, a.status) == ("NB", "Windows", 50, ["c1", "c0"], True, "up")
    assert (desktop["192.0.2.7"].hostname, desktop["192.0.2.7"].os_accuracy) == (None, 0)
    assert [(r.ttl, r.hop_ip) for r in nessus.trace(nested).orderBy("ttl").collect()] == [(1, "a"), (2, "b")]
    ports = lambda profile: sorted((r.port, r.proto, r.svc) for r in nessus.ports(nested, profile).collect())
    assert ports("web") == [(53, "udp", "dns"), (443, "tcp", None)] and ports("desktop")[1] == (443, "tcp", "?")
    found = {r.plugin_id: r for r in nessus.findings(nested).collect()}
    assert set(found) == {2, 3}
    f = found[2]
    assert (f.severity_label, f.cvss3, f.cvss, f.vpr, f.cves, f.exploit_available, f.port, f.output) == ("High", 7.5, None, None, ["CVE-1", "CVE-2"], True, 443, "a\n <b>")
    assert found[3].exploit_available is False
    assert {r.plugin_id: r.exploit_available for r in nessus.findings(nested, "desktop").collect()}[3] is True
    run = nessus.runs(read_records(spark, str(tmp_path), "</ReportHost>"), nested).first()
    assert (run.source_name, run.total) == ("weekly", 2)


def test_formats_and_rejects(spark, nmap_dir, tmp_path):
    (tmp_path / "a.xml").write_text(HEAD + HOST_B + STATS)
    (tmp_path / "b.nessus").write_text(nessus_text())
    (tmp_path / "c.txt").write_text("hello\nworld\n")
    formats = detect.file_formats(spark, str(tmp_path))
    assert {r.scan_id.rsplit("/", 1)[1]: r.format for r in formats.collect()} == {"a.xml": "nmap", "b.nessus": "nessus", "c.txt": "unknown"}
    assert [r.scan_id.rsplit("/", 1)[1] for r in detect.rejects(formats).collect()] == ["c.txt"]
    long = "<?xml version='1.0'?><!DOCTYPE nmaprun [<!ENTITY a 'b'>]>" + "<!-- <NessusClientData_v2> > " + "y" * 2000 + " -->"
    texts = [(" <nmaprun/>", "nmap"), ("x" * 600 + "<nmaprun/>", "unknown"), ("<NessusClientData_v2>", "nessus"), (long + "\n<nmaprun>", "nmap"), ("<html><nmaprun></html>", "unknown"), ("", "unknown"), ("<nmaprunner>", "unknown")]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r.f for r in df.select(detect.detect_format(F.col("t")).alias("f")).collect()] == [f for _, f in texts]


def test_file_formats_follow_the_first_element(spark, tmp_path):
    for name, text in {
        "a": "<?xml version='1.0'?>\n<!-- " + "z" * 2000 + " <x> -->\n<nmaprun a='1'><host/></nmaprun>", "b": "<page><!-- hi --><nmaprun/></page>", "c": "<NessusClientData_v2>\n</NessusClientData_v2>", "d": "no xml <nmaprun>",
    }.items():
        (tmp_path / f"{name}.xml").write_text(text)
    got = {r.scan_id[-5]: r.format for r in detect.file_formats(spark, str(tmp_path)).collect()}
    assert got == {"a": "nmap", "b": "unknown", "c": "nessus", "d": "unknown"}


def test_vulnerability_database_round_trip(spark, tmp_path, rows):
    (tmp_path / "db.json").write_text(json.dumps({
        "cpe:a": [{"cve": "C1", "cvss": 9.8, "desc": "d"}, {"cve": "C2", "severity": "HIGH", "description": "e"}], "cpe:empty": [],
    }, indent=2))
    db = vulndb.read_documents(spark, str(tmp_path / "db.json"))
    assert sorted(map(tuple, db.collect()), key=str) == [("cpe:a", 0, "C1", 9.8, None, "d"), ("cpe:a", 1, "C2", None, "HIGH", "e"), ("cpe:empty", None, None, None, None, None)]
    exports.write_vuln_db(db, str(tmp_path / "out"))
    again = vulndb.read_lines(spark, str(tmp_path / "out"))
    assert {(r.cpe, r.cve, r.cvss, r.descr) for r in again.collect()} == {("cpe:a", "C1", 9.8, "d"), ("cpe:a", "C2", None, "e")}


@pytest.mark.parametrize("entries", [1, 20_001])
def test_a_cpe_keeps_its_entries_and_their_places(spark, rows, tmp_path, entries):
    db = rows([{"cpe": "hot", "ord": n, "cve": f"C{n}"} for n in range(entries)] + [{"cpe": "cold", "ord": 0, "cve": "C0"}], VULN)
    exports.write_vuln_db(db, str(tmp_path / "db"))
    back = vulndb.read_lines(spark, str(tmp_path / "db")).collect()
    assert sorted((r.cpe, r.ord, r.cve) for r in back) == sorted([("cold", 0, "C0"), *(("hot", n, f"C{n}") for n in range(entries))])


def test_nvd_pages(spark, tmp_path):
    metric = lambda s: [{"cvssData": {"baseScore": s}}]
    match = lambda c, v=True: {"vulnerable": v, "criteria": c}
    cve = lambda i, **kw: {"cve": {"id": i, "published": "2024-03-01T10:00:00.000", "metrics": {}, "descriptions": [], **kw}}
    page = {"totalResults": 3, "vulnerabilities": [
        cve("A", metrics={"cvssMetricV2": metric(5.0), "cvssMetricV31": metric(9.1)}, descriptions=[{"lang": "fr", "value": "non"}, {"lang": "en", "value": "x" * 300}],
            configurations=[{"nodes": [{"cpeMatch": [match("c1"), match("c1"), match("c2", False), match("")]}]}, {"nodes": [{"cpeMatch": [match("c3")]}]}]),
        cve("B", metrics={"cvssMetricV2": metric(4.0)}), cve("C", published="2023-01-01T00:00:00.000", configurations=[]),
    ]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    cves = vulndb.read_nvd(spark, str(tmp_path))
    assert sorted((r.cpe, r.cve, r.cvss, len(r.descr)) for r in vulndb.cpe_cves(cves).collect()) == [("c1", "A", 9.1, 200), ("c3", "A", 9.1, 200)]
    assert sorted(r.id for r in vulndb.published_since(cves, "2024-03-10", 30).collect()) == ["A", "B"]
    assert [r.id for r in vulndb.matching_cpe(cves, "c*").collect()] == ["A"]


def test_tags_in_both_forms(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"mac:AA": {"labels": ["p1"], "owner": "o", "notes": "", "lastIp": "i", "lastSeen": "2024-01-02T03:04:05.000Z"}, "192.0.2.1": ["ckt", "crown"]}))
    got = {r.asset_key: r for r in tags.read_documents(spark, str(tmp_path)).collect()}
    assert got["192.0.2.1"].labels == ["ckt", "crown"] and got["192.0.2.1"].owner is None
    assert (got["mac:AA"].owner, got["mac:AA"].notes, got["mac:AA"].last_seen.year) == ("o", None, 2024)


def test_csv_quoting(spark, tmp_path, rows):
    host = {"scan_id": 1, "ip": "192.0.2.1", "hostname": 'a "b", c', "status": "up", "os_name": None}
    scored = rows([host], HOST).selectExpr("*", "7 AS risk", "2L AS open_ports", "1L AS cleartext_ports")
    ports = rows([{"scan_id": 1, "ip": "192.0.2.1", "port": p, "proto": "tcp", "state": "open"} for p in (443, 22)], PORT)
    exports.write_csv(exports.host_sheet(scored, ports), str(tmp_path / "full"), quote_all=True)
    exports.write_csv(exports.host_sheet_compact(scored), str(tmp_path / "compact"))
    read = lambda name: max((open(f).read() for f in glob.glob(f"{tmp_path}/{name}/*.csv")), key=len)
    assert read("full").splitlines() == ['"IP","Hostname","MAC","OS","Open Ports","Risk","Labels","Owner","Notes"', '"192.0.2.1","a ""b"", c","","","22;443","7","","",""']
    assert list(csv.reader(read("compact").splitlines())) == [["IP", "Hostname", "Status", "OS", "OpenPorts", "RiskScore", "CleartextCount"], ["192.0.2.1", 'a "b", c', "up", "", "2", "7", "1"]]


@pytest.mark.parametrize("count", [1, 20_001])
def test_json_documents_keep_every_finding_of_a_hot_host(spark, rows, tmp_path, count):
    from conftest import FINDING
    from exposure.inventory import Inventory

    hosts = rows([{"scan_id": 1, "ip": "hot", "status": "up"}, {"scan_id": 1, "ip": "bare", "status": "up"}], HOST)
    ports = rows([{"scan_id": 1, "ip": "hot", "port": 22, "proto": "tcp", "state": "open"}], PORT)
    findings = rows([{"scan_id": 1, "ip": "hot", "finding_ord": n, "plugin_id": n, "severity": 1} for n in range(count)], FINDING)
    exports.write_json(Inventory(hosts=hosts, ports=ports, findings=findings), str(tmp_path / "docs"))
    docs = [json.loads(line) for name in glob.glob(f"{tmp_path}/docs/*.txt") for line in open(name)]
    assert sorted(d["finding_ord"] for d in docs if d["kind"] == "finding") == list(range(count))
    assert {d["ip"]: [p["port"] for p in d.get("ports", [])] for d in docs if d["kind"] == "host"} == {"hot": [22], "bare": []}


def test_script_rules(spark):
    data = [("smb-vuln-ms17-010", "x"), ("vulners", "x"), ("http-title", "Title:  Hello "), ("ftp-anon", "Anonymous FTP login allowed"), ("ftp-anon", "no"), ("odd", "x")]
    df = spark.createDataFrame([(1, "h", None, i, o) for i, o in data], "scan_id int, ip string, port int, script_id string, output string")
    assert script_ops.vulnerability_scripts(df).count() == 2
    found = sorted((r.type, r.detail, r.severity or "") for r in script_ops.script_findings(df).collect())
    assert found == [("ftp", "Anonymous FTP!", "high"), ("ftp", "ftp-anon", "info"), ("http", "Hello", "")]
    assert set(S.PARSERS) == {"ssl-cert", "http-title", "http-server-header", "smb-os-discovery", "ssh-hostkey", "ftp-anon", "ms-sql-info", "mysql-info"}


def test_elements_are_parsed_once(spark, plan_of):
    """Conditions and columns read the parsed element, not the parser."""
    records = spark.range(2).selectExpr("'r' AS scan_id", "id AS host_ord", "concat('<host><address addr=\"10.0.0.', id, '\" addrtype=\"ipv4\"/><ports><port portid=\"22\"/></ports></host>') AS xml")
    named = spark.range(2).selectExpr("'r' AS scan_id", "id AS host_ord", "concat('<ReportHost name=\"10.0.0.', id, '\"/>') AS xml")
    for table in (nmap.ports(nmap.parse(records, F.col("xml"))), nessus.hosts(nessus.parse(named, F.col("xml"))), accounts.accepted(accounts.checked(records, "nmap", F.col("xml")))):
        assert plan_of(table).count("from_xml(") == 1
        assert sorted(r.ip for r in table.collect()) == ["10.0.0.0", "10.0.0.1"]
