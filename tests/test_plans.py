"""The plans the library relies on at scale, and the rules its source keeps."""

import pathlib
import re

from conftest import FINDING, HOST, PORT
from exposure.operators import risk, topk
from exposure.sources import elements
from pyspark.sql import functions as F

PACKAGE = pathlib.Path(__file__).parent.parent / "exposure"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_needs_no_window_and_no_sort(rows):
    text = plan(risk.score_hosts(rows([], HOST), rows([], PORT), rows([], FINDING)))
    assert "Window" not in text and "SortAggregate" not in text and "collect_list" not in text
    assert text.count("partial_count") >= 2


def test_previews_cut_groups_before_the_shuffle(rows):
    text = plan(topk.preview(rows([], FINDING), ["plugin_id"], [F.asc("finding_ord")], 3))
    first, second = text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")
    assert first < text.index("Exchange", first) < second


def test_filters_and_columns_reach_the_scan(spark, rows, tmp_path):
    rows([{"scan_id": 1, "ip": "a", "port": 1, "proto": "tcp", "state": "open", "cpe": "c"}], PORT).write.parquet(str(tmp_path / "p"))
    rows([{"scan_id": 1, "ip": "a", "status": "up"}], HOST).write.parquet(str(tmp_path / "h"))
    from exposure.operators import filters

    read = lambda name: spark.read.parquet(str(tmp_path / name))
    text = plan(filters.admin_hosts(filters.up_hosts(read("h")), read("p")))
    scans = re.findall(r"FileScan parquet.*", text)
    assert any("EqualTo(state,open)" in s and "ReadSchema: struct<scan_id:int,ip:string,port:int,state:string>" in s for s in scans)
    assert any("EqualTo(status,up)" in s for s in scans)


def test_reports_are_read_in_splits(spark, tmp_path):
    (tmp_path / "r.xml").write_text("<nmaprun>" + "<host>x</host>" * 3000 + "</nmaprun>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        records = elements.read_records(spark, str(tmp_path), "</host>")
        assert records.rdd.getNumPartitions() >= 5 and records.where(elements.has_element(F.col("value"), "host")).count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_source_rules():
    """No driver-side collection, Python UDFs, cross joins or lineage cuts on local disks, but for the training-data
    operators, which run Python in tasks and collect what has a bound."""
    banned = r"\.collect\(|toPandas|\.rdd\b|crossJoin|localCheckpoint|pandas_udf|\budf\(|mapInPandas|applyInPandas|toLocalIterator"
    for path in PACKAGE.rglob("*.py"):
        text = path.read_text()
        assert not re.search(r"crossJoin|localCheckpoint", text), path
        if "llm" not in path.relative_to(PACKAGE).parts:
            assert not re.search(banned, text), path


def test_broadcast_hints_name_only_constant_or_counted_tables():
    for path in (PACKAGE / "operators").rglob("*.py"):
        lines = path.read_text().splitlines()
        for before, line in zip(["", *lines], lines):
            if "F.broadcast(" in line and "if is_small(" not in before:
                assert re.search(r"F\.broadcast\((dims\.\w+_dim|dim\.|dim\b)", line), line


def test_many_scan_pairs_are_not_joined_by_scan_alone(spark, rows, monkeypatch):
    from conftest import HOST
    from exposure.operators import diff

    hosts = rows([{"scan_id": s, "ip": f"h{i}", "status": "up" if i % s else "down"} for s in (1, 2) for i in range(1, 40)], HOST)
    pairs = diff.scan_pair(spark, 1, 2)
    broadcast = diff.host_sides(hosts, pairs)
    monkeypatch.setattr(diff, "is_small", lambda df: False)
    salted = diff.host_sides(hosts, pairs)
    assert sorted(map(str, broadcast.collect())) == sorted(map(str, salted.collect()))
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((scan_id|of_scan)#\d+L?, \d+\)", plan)
