"""Bounded previews: the first n rows per group, with how many more there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposure.functions import columns as C


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group in ``order``, with their ``rank``.

    The filter on the rank lets Spark cut each group to ``n`` rows per partition
    before the shuffle, so a huge group never meets in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def preview(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """:func:`top_n_per_group` plus ``more``: how many rows of the group are not shown.

    Group sizes come from a separate pre-aggregated count; counting over the whole
    window would bring each group together.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"))
    shown = top_n_per_group(df, keys, order, n).join(sizes, keys)
    return shown.withColumn("more", F.greatest(F.col("group_size") - n, F.lit(0).cast("bigint"))).drop("group_size")


def first_cleartext(ports: DataFrame, hosts: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` cleartext services on up hosts, by scan, IP, port and protocol."""
    from exposure.operators.rollups import cleartext_services

    return cleartext_services(hosts, ports).orderBy("scan_id", "ip", "port", "proto").limit(n)


def sort_entities(scored: DataFrame, by: str = "risk", n: int | None = None) -> DataFrame:
    """Hosts by ``risk`` (highest first), ``ip`` or ``ports`` (most first); ties by scan and IP."""
    keys = {"risk": [F.desc("risk")], "ip": [F.asc("ip")], "ports": [F.desc("port_rows")]}[by]
    out = scored.orderBy(*keys, "scan_id", "ip")
    return out if n is None else out.limit(n)


def placed(df: DataFrame, order: list[Column], path: str) -> DataFrame:
    """``df`` with its ``place`` (from 1) in ``order``, which must leave no ties if places are to be repeatable.

    Rows are range partitioned and sorted once and written to ``path``, which all executors must reach, with their partition and number in
    it. A place is that number plus the rows of the partitions before, so the only sums over partitions are of one row a task. A range
    holds about as many rows as any other, whichever key is frequent, as long as ``order`` tells its rows apart.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("*", F.spark_partition_id().alias("_part"), number.alias("_number")).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    counted = stored.join(sizes.select("_part", before.alias("_before")), "_part")
    return counted.select(*df.columns, (F.col("_before") + F.col("_number") + 1).alias("place"))


def placed_in_groups(df: DataFrame, keys: list[str], order: list[Column], path: str) -> DataFrame:
    """``df`` with its ``place`` in ``order`` within the rows of ``keys``: the place among all rows less that of the group's first, so that
    no group is sorted in one task."""
    rows = placed(df, [*[F.asc(k) for k in keys], *order], path)
    first = rows.groupBy(*keys).agg(F.min("place").alias("_first"))
    return rows.join(first, keys).select(*df.columns, (F.col("place") - F.col("_first") + 1).alias("place"))


def place_entities(scored: DataFrame, by: str, path: str) -> DataFrame:
    """Every host with its ``place`` by ``risk`` (highest first), ``ip`` or ``ports`` (most first); ties by scan and IP."""
    first = {"risk": [F.desc("risk")], "ip": [F.asc("ip")], "ports": [F.desc("port_rows")]}[by]
    return placed(scored, [*first, F.asc("scan_id"), F.asc("ip")], path)


def place_findings(findings: DataFrame, path: str) -> DataFrame:
    """Findings with their ``place`` within their host, in the order of :func:`order_findings`."""
    score = F.coalesce("cvss3", "cvss", F.lit(0.0))
    return placed_in_groups(findings, C.HOST_KEY, [F.desc("severity"), F.desc(score), F.asc("finding_ord")], path)


def order_findings(findings: DataFrame) -> DataFrame:
    """Findings by severity, then CVSS (v3 before v2), highest first, within each host."""
    score = F.coalesce("cvss3", "cvss", F.lit(0.0))
    return findings.orderBy("scan_id", "ip", F.desc("severity"), F.desc(score), "finding_ord")


def identification_signals(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """What identifies each host: OS guess, MAC and the first two products on open ports.

    Only hosts with an OS guess or a MAC have signals.
    """
    known = hosts.where(F.col("os_name").isNotNull() | F.col("mac").isNotNull())
    vendor = F.col("mac_vendor") if "mac_vendor" in hosts.columns else F.lit(None).cast("string")
    products = ports.where((F.col("state") == "open") & F.col("product").isNotNull())
    first_two = top_n_per_group(products, C.HOST_KEY, [F.asc("port"), F.asc("proto")], 2)
    port_rows = first_two.join(known.select(*C.HOST_KEY), C.HOST_KEY, "left_semi").select(
        *C.HOST_KEY, (F.col("rank") + 2).alias("position"), F.concat(F.lit(":"), F.col("port").cast("string")).alias("source"),
        F.concat_ws(" ", "product", "version").alias("value"), F.lit(None).cast("int").alias("confidence"),
    )
    os_rows = known.where(F.col("os_name").isNotNull()).select(
        *C.HOST_KEY, F.lit(1).alias("position"), F.lit("OS").alias("source"), F.col("os_name").alias("value"), F.col("os_accuracy").alias("confidence")
    )
    mac_rows = known.where(F.col("mac").isNotNull()).select(
        *C.HOST_KEY, F.lit(2).alias("position"), F.lit("MAC").alias("source"),
        F.when(vendor.isNotNull(), F.concat(F.col("mac"), F.lit(" ("), vendor, F.lit(")"))).otherwise(F.col("mac")).alias("value"),
        F.lit(None).cast("int").alias("confidence"),
    )
    return os_rows.unionByName(mac_rows).unionByName(port_rows)
