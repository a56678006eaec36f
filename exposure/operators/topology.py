"""The traceroute graph: nodes and edges as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from exposure.functions import columns as C

KEY = C.HOST_KEY
SCANNER = "scanner"
TARGET_LEVEL, HOP_LEVEL = 10, 5


def _hops(hosts: DataFrame, trace: DataFrame) -> DataFrame:
    """Answering hops of up hosts."""
    up = hosts.where(F.col("status") == "up").select(*KEY)
    return trace.where(F.col("hop_ip").isNotNull() & ~F.col("hop_ip").isin("", "*")).join(up, KEY, "left_semi")


def edges(hosts: DataFrame, trace: DataFrame) -> DataFrame:
    """Scanner to hop to hop to target, one row per traversal; repeats are kept.

    Up hosts without any trace get a direct edge from the scanner. The window runs
    over one host's trace, which has at most 255 hops.
    """
    hops = _hops(hosts, trace)
    in_trace = Window.partitionBy(*KEY).orderBy("hop_ord")
    before = F.coalesce(F.lag("hop_ip").over(in_trace), F.lit(SCANNER))
    along = hops.select(*KEY, before.alias("from_node"), F.col("hop_ip").alias("to_node"), "ttl")
    up = hosts.where(F.col("status") == "up").select(*KEY)
    last = hops.groupBy(*KEY).agg(F.max_by("hop_ip", "hop_ord").alias("last_hop"))
    tail = (
        up.join(last, KEY, "left")
        .select(*KEY, F.coalesce("last_hop", F.lit(SCANNER)).alias("from_node"), F.col("ip").alias("to_node"), F.lit(None).cast("int").alias("ttl"))
        .where(F.col("from_node") != F.col("to_node"))
    )
    return along.unionByName(tail)


def edge_weights(edge_rows: DataFrame) -> DataFrame:
    """Per scan and node pair: traversals and lowest ttl."""
    return edge_rows.groupBy("scan_id", "from_node", "to_node").agg(F.count(F.lit(1)).alias("traversals"), F.min("ttl").alias("min_ttl"))


def nodes(hosts: DataFrame, trace: DataFrame) -> DataFrame:
    """Scanner, targets and hops with label, ttl and level; a target outranks a hop.

    A hop takes label and ttl from its first sighting by host IP and hop order. The
    sightings of a core router pre-aggregate on the map side.
    """
    none = F.lit(None).cast("int")
    up = hosts.where(F.col("status") == "up")
    targets = up.select(
        "scan_id", F.col("ip").alias("node"), F.lit(1).alias("rank"), F.col("ip").alias("via"), F.lit(0).alias("hop_ord"),
        F.coalesce("hostname", "ip").alias("label"), none.alias("ttl"),
    )
    hops = _hops(hosts, trace).select(
        "scan_id", F.col("hop_ip").alias("node"), F.lit(2).alias("rank"), F.col("ip").alias("via"), F.col("hop_ord").cast("int").alias("hop_ord"),
        F.coalesce("hop_host", "hop_ip").alias("label"), F.col("ttl"),
    )
    scanner = up.groupBy("scan_id").agg(F.lit(1).alias("one")).select(
        "scan_id", F.lit(SCANNER).alias("node"), F.lit(0).alias("rank"), F.lit("").alias("via"), F.lit(0).alias("hop_ord"),
        F.lit("Scanner").alias("label"), none.alias("ttl"),
    )
    best = (
        targets.unionByName(hops).unionByName(scanner)
        .groupBy("scan_id", "node").agg(F.min(F.struct("rank", "via", "hop_ord", "label", "ttl")).alias("n"))
    )
    kind = C.case_of(F.col("n.rank"), {0: "scanner", 1: "target", 2: "hop"})
    fallback = C.case_of(F.col("n.rank"), {0: 0, 1: TARGET_LEVEL, 2: HOP_LEVEL})
    return best.select(
        "scan_id", "node", kind.alias("type"), F.col("n.label").alias("label"), F.col("n.ttl").alias("ttl"),
        F.coalesce(F.nullif(F.col("n.ttl"), F.lit(0)), fallback).alias("level"),
    )


def node_counts(node_rows: DataFrame) -> DataFrame:
    """Per scan: nodes by type."""
    return node_rows.groupBy("scan_id", "type").agg(F.count(F.lit(1)).alias("nodes"))


def paths(trace: DataFrame, ip: str | None = None) -> DataFrame:
    """The path of one host, or of every host, by ttl; unanswered hops show as ``*``."""
    rows = trace if ip is None else trace.where(F.col("ip") == ip)
    return rows.select(
        *KEY, "ttl", F.coalesce(C.blank_to_null(F.col("hop_ip")), F.lit("*")).alias("hop_ip"),
        F.coalesce("hop_host", F.lit("")).alias("hop_host"),
        "rtt",
    ).orderBy("scan_id", "ip", "ttl")
