"""Scan-to-scan differences and the scan timeline.

Every function takes ``pairs`` (``base_id``, ``comp_id``) and compares all pairs in one
plan. A side is tagged 1 (base) or 2 (comparison); the bitwise OR of the tags of a key
says where it was seen, so presence needs one hash aggregation instead of a
full outer join plus two anti joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from exposure.sizes import is_small

PAIR = ["base_id", "comp_id"]
BASE, COMP, BOTH = 1, 2, 3


def scan_pair(spark: SparkSession, base, comp) -> DataFrame:
    """One pair of scans to compare."""
    return spark.range(1).select(F.lit(base).alias("base_id"), F.lit(comp).alias("comp_id"))


def consecutive_pairs(runs: DataFrame) -> DataFrame:
    """Each scan with the one before it, by start time, then id.

    A lag over all scans would sort them in one task. Here scans are ordered within
    their second; the first of a second takes the last scan of the previous second
    of that day, or of the previous day. The carried values live in tables of at
    most one row per second of a day, and of one row per day.
    """
    runs = runs.select("scan_id", "started_at").withColumn("second", F.date_trunc("second", "started_at"))
    order = F.struct("started_at", "scan_id")
    seconds = runs.groupBy("second").agg(F.max_by("scan_id", order).alias("last")).withColumn("day", F.to_date("second"))
    days = seconds.groupBy("day").agg(F.max_by("last", "second").alias("last"))
    days = days.select("day", F.lag("last").over(Window.orderBy("day")).alias("day_before"))
    in_day = Window.partitionBy("day").orderBy("second")
    carried = (
        seconds.withColumn("second_before", F.lag("last").over(in_day)).join(days, "day")
        .select("second", F.coalesce("second_before", "day_before").alias("carried"))
    )
    in_second = Window.partitionBy("second").orderBy("started_at", "scan_id")
    return (
        runs.withColumn("here_before", F.lag("scan_id").over(in_second)).join(carried, "second")
        .select(F.coalesce("here_before", "carried").alias("base_id"), F.col("scan_id").alias("comp_id"))
        .where(F.col("base_id").isNotNull())
    )


SALTS = 64


def _sides(df: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both sides of every pair, tagged with ``side``.

    Pairs become one row per scan and side, so the facts are read once. Few pairs are
    broadcast; more of them are joined by scan and a salt of the IP, never by scan alone,
    which would gather a scan's rows in one task, and by sorting, as the salts make them
    many more rows than Spark takes them for.
    """
    side = lambda key, value: F.struct(F.col(key).alias("of_scan"), F.lit(value).alias("side"))
    sides = pairs.select(*PAIR, F.explode(F.array(side("base_id", BASE), side("comp_id", COMP))).alias("s")).select(*PAIR, "s.*")
    same_scan = df["scan_id"] == F.col("of_scan")
    if is_small(sides):
        return df.join(F.broadcast(sides), same_scan).select(*PAIR, *columns, "side")
    salted = sides.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.join(salted.hint("merge"), same_scan & (F.pmod(F.xxhash64(df["ip"]), F.lit(SALTS)) == F.col("salt"))).select(*PAIR, *columns, "side")


def host_sides(hosts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and IP: where it was seen, and OS and status on each side."""
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return _sides(hosts, pairs, ["ip", "os_name", "status"]).groupBy(*PAIR, "ip").agg(
        F.bit_or("side").alias("seen"),
        on(BASE, "os_name").alias("base_os"), on(COMP, "os_name").alias("comp_os"),
        on(BASE, "status").alias("base_status"), on(COMP, "status").alias("comp_status"),
    )


def port_presence(ports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair, IP and port/protocol: whether it was open in the base, the comparison, or both."""
    opened = ports.where(F.col("state") == "open")
    return _sides(opened, pairs, ["ip", "port", "proto"]).groupBy(*PAIR, "ip", "port", "proto").agg(F.bit_or("side").alias("seen"))


def added_ports(ports: DataFrame, pairs: DataFrame) -> DataFrame:
    return port_presence(ports, pairs).where(F.col("seen") == COMP).drop("seen")


def removed_ports(ports: DataFrame, pairs: DataFrame) -> DataFrame:
    return port_presence(ports, pairs).where(F.col("seen") == BASE).drop("seen")


def _change(df: DataFrame, kind, port, before, after) -> DataFrame:
    return df.select(*PAIR, "ip", kind.alias("type"), port.alias("port"), before.alias("from_value"), after.alias("to_value"))


def _port_changes(sides: DataFrame, presence: DataFrame) -> DataFrame:
    both = sides.where(F.col("seen") == BOTH).select(*PAIR, "ip")
    changed = presence.where(F.col("seen") != BOTH).join(both, [*PAIR, "ip"], "left_semi")
    none = F.lit(None).cast("string")
    label = F.concat(F.col("port").cast("string"), F.lit("/"), F.col("proto"))
    return _change(changed, F.when(F.col("seen") == COMP, "port_added").otherwise("port_removed"), label, none, none)


def port_changes(hosts: DataFrame, ports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ports opened or closed on hosts seen in both scans."""
    return _port_changes(host_sides(hosts, pairs), port_presence(ports, pairs))


def _os_changes(sides: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    changed = sides.where((F.col("seen") == BOTH) & (blank("base_os") != blank("comp_os")))
    return _change(changed, F.lit("os_changed"), F.lit(None).cast("string"), blank("base_os"), blank("comp_os"))


def _status_changes(sides: DataFrame) -> DataFrame:
    changed = sides.where((F.col("seen") == BOTH) & ~F.col("base_status").eqNullSafe(F.col("comp_status")))
    return _change(changed, F.lit("status_changed"), F.lit(None).cast("string"), F.col("base_status"), F.col("comp_status"))


def os_changes(hosts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hosts in both scans whose best OS guess differs; none counts as ``''``."""
    return _os_changes(host_sides(hosts, pairs))


def status_changes(hosts: DataFrame, pairs: DataFrame) -> DataFrame:
    return _status_changes(host_sides(hosts, pairs))


def log_of(sides: DataFrame, presence: DataFrame) -> DataFrame:
    """The change log of hosts and open ports whose sides are known."""
    return _port_changes(sides, presence).unionByName(_os_changes(sides)).unionByName(_status_changes(sides))


def change_log(hosts: DataFrame, ports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every change on hosts seen in both scans: type, port, from and to."""
    return log_of(host_sides(hosts, pairs), port_presence(ports, pairs))


def diff_of(sides: DataFrame, presence: DataFrame) -> DataFrame:
    """Per pair and IP, of hosts and open ports whose sides are known: what became of the host, with the number of changes."""
    moved = presence.where(F.col("seen") != BOTH).groupBy(*PAIR, "ip").agg(F.count(F.lit(1)).alias("port_changes"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda cond: F.when(cond, 1).otherwise(0)
    changes = (
        F.coalesce("port_changes", F.lit(0).cast("bigint")) + number(blank("base_os") != blank("comp_os"))
        + number(~F.col("base_status").eqNullSafe(F.col("comp_status")))
    )
    both = F.col("seen") == BOTH
    return sides.join(moved, [*PAIR, "ip"], "left").select(
        *PAIR, "ip",
        F.when(F.col("seen") == COMP, "new").when(F.col("seen") == BASE, "removed").when(changes > 0, "changed").otherwise("unchanged").alias("diff"),
        F.when(both, changes).otherwise(0).cast("bigint").alias("changes"),
    )


def host_diff(hosts: DataFrame, ports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair and IP: ``new``, ``removed``, ``changed`` or ``unchanged``, with the number of changes."""
    return diff_of(host_sides(hosts, pairs), port_presence(ports, pairs))


def diff_summary(hosts: DataFrame, ports: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: new, removed, changed and unchanged hosts."""
    kinds = {"new": "new_hosts", "removed": "removed_hosts", "changed": "changed_hosts", "unchanged": "unchanged_hosts"}
    return host_diff(hosts, ports, pairs).groupBy(*PAIR).agg(*[F.count_if(F.col("diff") == k).alias(n) for k, n in kinds.items()])


def scan_series(runs: DataFrame, hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Per scan, in time order: hosts, up hosts and open ports."""
    by_host = hosts.groupBy("scan_id").agg(F.count(F.lit(1)).alias("hosts"), F.count_if(F.col("status") == "up").alias("hosts_up"))
    by_port = ports.where(F.col("state") == "open").groupBy("scan_id").agg(F.count(F.lit(1)).alias("open_ports"))
    zero = F.lit(0).cast("bigint")
    return (
        runs.join(by_host, "scan_id", "left").join(by_port, "scan_id", "left")
        .select(
            "scan_id", "source_name", "started_at",
            *[F.coalesce(c, zero).alias(c) for c in ("hosts", "hosts_up", "open_ports")],
        )
        .orderBy("started_at", "scan_id")
    )


def scan_trend(series: DataFrame, height: float = 150.0) -> DataFrame:
    """The series scaled so that its maximum is ``height``.

    The maxima are scalar subqueries over the already aggregated series; a window over
    everything would move all scans to one task.
    """
    peak = lambda c: F.nullif(series.agg(F.max(c)).scalar(), F.lit(0))
    scaled = lambda c: F.round(F.col(c) / peak(c) * height, 6)
    return series.select("scan_id", "started_at", scaled("hosts_up").alias("host_height"), scaled("open_ports").alias("port_height"))


def timeline_changes(runs: DataFrame, hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Consecutive scans that differ, with the diff summary of each pair."""
    summary = diff_summary(hosts, ports, consecutive_pairs(runs))
    start = lambda key, name: runs.select(F.col("scan_id").alias(key), F.col("started_at").alias(name))
    return (
        summary.where((F.col("new_hosts") > 0) | (F.col("removed_hosts") > 0) | (F.col("changed_hosts") > 0))
        .join(start("base_id", "from_time"), "base_id").join(start("comp_id", "to_time"), "comp_id")
    )
