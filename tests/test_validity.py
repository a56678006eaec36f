"""Validity runs against the differences read from the facts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from conftest import HOST, PORT
from exposure.operators import diff, validity

RUN = "scan_id int, started_at timestamp, note string"
DAY = datetime.datetime(2024, 1, 1)


def tables(rows, seed, scans):
    rng = random.Random(seed)
    times = rng.sample(range(scans * 3), scans)
    runs = [{"scan_id": i, "started_at": DAY + datetime.timedelta(hours=9 * t)} for i, t in enumerate(times)]
    hosts, ports = [], []
    for ip in [f"10.0.0.{n}" for n in range(6)]:
        there, os_name, status, opened = True, None, "up", {22}
        for scan in sorted(range(scans), key=times.__getitem__):  # states that last for some scans, and gaps
            there = rng.random() < 0.8 if rng.random() < 0.2 else there
            os_name = rng.choice([None, "", "x", "y"]) if rng.random() < 0.1 else os_name
            status = rng.choice([None, "up", "down"]) if rng.random() < 0.1 else status
            opened = opened ^ {rng.randrange(4)} if rng.random() < 0.3 else opened
            if there:
                host = {"scan_id": scan, "ip": ip, "os_name": os_name, "status": status}
                hosts += [host] * rng.choice([1, 1, 2])
                ports += [{"scan_id": scan, "ip": ip, "port": n, "proto": "tcp", "state": "open"} for n in opened for _ in range(rng.choice([1, 2]))]
                ports.append({"scan_id": scan, "ip": ip, "port": 9, "proto": "tcp", "state": "closed"})
    ports.append({"scan_id": 0, "ip": "no.host", "port": 1, "proto": "tcp", "state": "open"})
    hosts.append({"scan_id": 3, "ip": None, "os_name": "z"})
    return rows(runs, RUN), rows(hosts, HOST).cache(), rows(ports, PORT).cache()


same = lambda a, b: sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))


@pytest.mark.parametrize("seed,scans", [(1, 7), (2, 150)])
def test_steps_equal_the_direct_differences(rows, spark, tmp_path, seed, scans):
    runs, hosts, ports = tables(rows, seed, scans)
    validity.write(validity.build(runs, hosts, ports), str(tmp_path / "v"))
    v, pairs = validity.load(spark, str(tmp_path / "v")), diff.consecutive_pairs(runs).cache()
    assert same(validity.step_log(v), diff.change_log(hosts, ports, pairs))
    named = hosts.where("ip IS NOT NULL")
    named_v = validity.Validity(v.places, v.states.where("ip IS NOT NULL"), v.ports)
    assert same(validity.step_summary(named_v), diff.diff_summary(named, ports, pairs))


def test_any_pairs_equal_the_direct_differences(rows, spark, monkeypatch):
    runs, hosts, ports = tables(rows, 3, 70)
    v = validity.build(runs, hosts, ports)
    pairs = rows([{"base_id": a, "comp_id": b} for a, b in [(0, 69), (69, 0), (5, 5), (1, 40), (12, 13), (0, 1)]], "base_id int, comp_id int")
    assert same(validity.host_sides(v, pairs), diff.host_sides(hosts, pairs))
    assert same(validity.log_between(v, pairs), diff.change_log(hosts, ports, pairs))
    assert same(validity.diff_between(v, pairs), diff.host_diff(hosts, ports, pairs))
    monkeypatch.setattr(validity, "is_small", lambda df: False)
    assert same(validity.port_presence(v, pairs), diff.port_presence(ports, pairs))


def test_runs_are_the_longest(rows):
    places = [1, 2, 3, 5, 63, 64, 65, 127, 128, 129, 191, 192, 300]
    facts = rows([{"k": "a", "place": n} for n in places + places] + [{"k": None, "place": 7}], "k string, place bigint")
    found = {tuple(r) for r in validity.presence_runs(facts, ["k"]).collect()}
    assert found == {("a", 1, 3), ("a", 5, 5), ("a", 63, 65), ("a", 127, 129), ("a", 191, 192), ("a", 300, 300), (None, 7, 7)}


def test_each_covered_place_is_met_once(rows, spark):
    rng = random.Random(4)
    spans = [(n, f := rng.randrange(1, 400), f + rng.choice([0, 1, 5, 300])) for n in range(60)]
    runs = spark.createDataFrame([(str(n), a, b) for n, a, b in spans], "ip string, first_place bigint, last_place bigint")
    points = spark.range(1, 720).select(F.col("id").alias("place"))
    met = [(r.ip, r.place) for r in validity.covering(runs, points).collect()]
    assert len(met) == len(set(met)) and set(met) == {(str(n), p) for n, a, b in spans for p in range(a, b + 1)}


def test_steady_keys_leave_one_row_and_the_facts_are_not_read_again(rows, spark, tmp_path):
    runs = rows([{"scan_id": n, "started_at": DAY + datetime.timedelta(days=n)} for n in range(200)], RUN)
    hosts = rows([{"scan_id": n, "ip": "a", "status": "up"} for n in range(200)], HOST)
    ports = rows([{"scan_id": n, "ip": "a", "port": 80, "proto": "tcp", "state": "open"} for n in range(200)], PORT)
    validity.write(validity.build(runs, hosts, ports), str(tmp_path / "v"))
    v = validity.load(spark, str(tmp_path / "v"))
    assert v.ports.count() == 1 and v.states.count() == 1 and v.places.count() == 200
    assert validity.step_log(v).count() == 0
    assert [tuple(r) for r in validity.diff_between(v, diff.scan_pair(spark, 0, 199)).collect()] == [(0, 199, "a", "unchanged", 0)]


def test_empty_and_untimed(rows):
    none = rows([], RUN), rows([], HOST), rows([], PORT)
    v = validity.build(*none)
    assert validity.step_log(v).count() == validity.step_summary(v).count() == 0
    assert validity.log_between(v, rows([], "base_id int, comp_id int")).count() == 0
    untimed = validity.scan_places(rows([{"scan_id": 1}, {"scan_id": 2, "started_at": DAY}], RUN))
    assert [tuple(r) for r in untimed.collect()] == [(2, 1)]


def test_cut_runs_are_joined_by_sorting(rows, spark, tmp_path, plan_of):
    """Small files hold many runs, and each run and border stands once for each level, so neither side may be broadcast."""
    runs, hosts, ports = tables(rows, 4, 12)
    validity.write(validity.build(runs, hosts, ports), str(tmp_path / "v"))
    v = validity.load(spark, str(tmp_path / "v"))
    covered = validity.covering(v.states, validity._borders(v.ports, validity._last(v)), ["ip"])
    assert "SortMergeJoin" in plan_of(covered) and "BroadcastHashJoin" not in plan_of(covered)


def test_few_words_are_shuffled_once_and_give_the_same_runs(rows, plan_of):
    rng = random.Random(5)
    facts = rows([{"k": rng.choice(["a", "b", None]), "place": rng.randrange(1, 400)} for _ in range(300)], "k string, place bigint")
    aside = validity.presence_runs(facts, ["k"], 399)
    assert same(aside, validity.presence_runs(facts, ["k"])) and same(aside, validity.presence_runs(facts, ["k"], 1 << 20))
    assert plan_of(aside).count("Exchange hashpartitioning") == 1


def test_ports_in_both_scans_leave_before_the_shuffle(rows, spark, tmp_path, plan_of):
    runs, hosts, ports = tables(rows, 6, 30)
    validity.write(validity.build(runs, hosts, ports), str(tmp_path / "v"))
    v = validity.load(spark, str(tmp_path / "v"))
    pairs = rows([{"base_id": a, "comp_id": b} for a, b in [(0, 29), (29, 0), (5, 5), (1, 14), (12, 13)]], "base_id int, comp_id int")
    assert same(validity.moved_ports(v, pairs), diff.port_presence(ports, pairs).where(F.col("seen") != diff.BOTH))
    moved = validity.moved_ports(v, pairs)
    by_host = moved.groupBy(*diff.PAIR, "ip").count()
    assert plan_of(by_host).count("Exchange hashpartitioning") == plan_of(moved).count("Exchange hashpartitioning")
