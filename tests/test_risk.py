"""Hand-computed and brute-force checks of scoring."""

import math
import random

import pytest

from conftest import FINDING, HOST, PORT
from exposure import dims
from exposure.operators import risk


def brute(ports, findings, profile="web"):
    """The score computed the long way: sort the weights, divide by log2(i + 2)."""
    weights = []
    for p in ports:
        if p["state"] != "open":
            continue
        svc = p.get("svc") or ""
        svc = svc if profile == "web" else svc.lower()
        w = max(dims.PORT_RISK[profile].get(p["port"], 0), dims.SERVICE_RISK[profile].get(svc, 0))
        if p["port"] in dims.PORT_CLEARTEXT[profile] or svc in dims.SERVICE_CLEARTEXT[profile]:
            w += 3
        weights.append(w)
    curve = lambda ws: sum(w / math.log2(i + 2) for i, w in enumerate(sorted((w for w in ws if w > 0), reverse=True)))
    each = [dims.SEVERITY_RISK.get(f["severity"], 0) + (5 if f["exploit_available"] else 0) for f in findings]
    finding_risk = curve(each) if profile == "web" else sum(each)
    top = round(max(curve(weights), finding_risk), 9)
    return min(100, math.floor(top + 0.5) if profile == "web" else math.floor(top))


def scores(rows, spark, cases, profile="web"):
    hosts = [{"scan_id": 1, "ip": f"10.0.0.{i}", "status": "up"} for i in range(len(cases))]
    ports = [{"scan_id": 1, "ip": f"10.0.0.{i}", "proto": "tcp", **p} for i, (ps, _) in enumerate(cases) for p in ps]
    found = [{"scan_id": 1, "ip": f"10.0.0.{i}", "finding_ord": n, "plugin_id": n, **f} for i, (_, fs) in enumerate(cases) for n, f in enumerate(fs)]
    out = risk.score_hosts(rows(hosts, HOST), rows(ports, PORT), rows(found, FINDING), profile)
    return {r.ip: r for r in out.collect()}


def cases():
    rng = random.Random(3)
    known_ports = sorted(set(dims.PORT_RISK["web"]) | set(dims.PORT_CLEARTEXT["desktop"])) + [1, 40000]
    known_svcs = sorted(dims.SERVICE_RISK["web"]) + ["LDAP", "Telnet", "gopher", None, "nothing"]
    out = [([], []), ([{"port": 23, "state": "closed"}], []), ([{"port": 1, "state": "open", "svc": "nothing"}], [])]
    for _ in range(25):
        ps = [{"port": p, "state": rng.choice(["open", "open", "filtered"]), "svc": rng.choice(known_svcs)} for p in rng.sample(known_ports, rng.randint(0, 20))]
        fs = [{"severity": rng.randint(1, 4), "exploit_available": rng.random() < 0.3} for _ in range(rng.randint(0, 6))]
        out.append((ps, fs))
    out.append(([], [{"severity": 1, "exploit_available": False}] * 3000))
    return out


def test_matches_brute_force_in_both_profiles(rows, spark):
    for profile in dims.PROFILES:
        data = cases()
        got = scores(rows, spark, data, profile)
        assert {ip: r.risk for ip, r in got.items()} == {f"10.0.0.{i}": brute(*c, profile) for i, c in enumerate(data)}


def test_hand_computed(rows, spark):
    telnet = {"port": 23, "state": "open", "svc": "telnet"}
    ssh = {"port": 22, "state": "open", "svc": "ssh"}
    got = scores(rows, spark, [([telnet], []), ([telnet, ssh], []), ([ssh], [{"severity": 4, "exploit_available": True}])])
    # 10 + 3 cleartext; then 3 / log2(3) = 1.89 more; critical with exploit = 30
    assert [got[f"10.0.0.{i}"].risk for i in range(3)] == [13, 15, 30]
    assert got["10.0.0.1"].top_port == 23 and got["10.0.0.1"].open_ports == 2


def test_profiles_differ_where_stated(rows, spark):
    upper = [([{"port": 5000, "state": "open", "svc": "LDAP"}], []), ([], [{"severity": 2, "exploit_available": False}] * 3)]
    web, desktop = scores(rows, spark, upper), scores(rows, spark, upper, "desktop")
    assert web["10.0.0.0"].risk == 0 and desktop["10.0.0.0"].risk == 9
    assert web["10.0.0.1"].risk == 11 and desktop["10.0.0.1"].risk == 15


def test_opening_a_port_never_lowers_the_score(rows, spark):
    rng = random.Random(5)
    base = [{"port": p, "state": "open"} for p in rng.sample(sorted(dims.PORT_RISK["web"]), 8)]
    chain = [(base[:n], []) for n in range(len(base) + 1)]
    got = scores(rows, spark, chain)
    values = [got[f"10.0.0.{i}"].risk for i in range(len(chain))]
    assert values == sorted(values) and all(0 <= v <= 100 for v in values)


def test_many_findings_stay_at_the_cap(rows, spark):
    got = scores(rows, spark, [([], [{"severity": 4, "exploit_available": True}] * 5000)])
    assert got["10.0.0.0"].risk == 100 and got["10.0.0.0"].findings == 5000


def test_dashboard_rules(rows, spark):
    schema = "scan_id int, ip string, status string, open_ports bigint, cleartext_ports bigint, risk int"
    scored = rows(
        [
            {"scan_id": 1, "ip": "a", "status": "up", "open_ports": 2, "cleartext_ports": 1, "risk": 11},
            {"scan_id": 1, "ip": "b", "status": "up", "open_ports": 0, "cleartext_ports": 0, "risk": 0},
            {"scan_id": 1, "ip": "c", "status": "down", "open_ports": 1, "cleartext_ports": 1, "risk": 30},
        ],
        schema,
    )
    web, desktop = risk.dashboard_totals(scored).first(), risk.dashboard_totals(scored, "desktop").first()
    assert (web.hosts, web.hosts_up, web.open_ports, web.cleartext_services, web.average_risk) == (3, 2, 3, 1, 11)
    assert (desktop.cleartext_services, desktop.average_risk) == (2, 20)


def test_rank_contributions_have_no_cap(rows):
    ports = rows([{"scan_id": 1, "ip": "a", "port": 20000 + n, "proto": "tcp", "state": "open", "svc": "https"} for n in range(3000)], PORT)
    (rank,) = risk.weight_ranks(ports).collect()
    assert (rank.first_rank, rank.last_rank) == (1, 3000)
    assert rank.contribution == pytest.approx(rank.score_weight * sum(1 / math.log2(k + 1) for k in range(1, 3001)), abs=1e-5)
