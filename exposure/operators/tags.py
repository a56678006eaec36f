"""Analyst tags: joining them to hosts, editing them and reporting on them.

A tag row is keyed by asset key. Records from an older format are keyed by a bare IP.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from exposure import dims
from exposure.functions import columns as C

TAG_COLUMNS = ["asset_key", "labels", "owner", "notes", "last_ip", "last_seen"]


def with_asset_key(hosts: DataFrame) -> DataFrame:
    return hosts.withColumn("asset_key", C.asset_key(F.col("mac"), F.col("ip")))


def with_tags(hosts: DataFrame, tags: DataFrame) -> DataFrame:
    """Hosts with ``labels``, ``owner`` and ``notes``; the asset key wins over a bare-IP record.

    Two equi-joins rather than one join with an OR, which would be a nested loop.
    """
    values = ["labels", "owner", "notes"]
    keyed = tags.where(F.col("asset_key").rlike("^(mac|ip):"))
    bare = tags.where(~F.col("asset_key").rlike("^(mac|ip):"))
    by_key = keyed.select("asset_key", F.struct(*values).alias("by_key"))
    by_ip = bare.select(F.col("asset_key").alias("ip"), F.struct(*values).alias("by_ip"))
    joined = with_asset_key(hosts).join(by_key, "asset_key", "left").join(by_ip, "ip", "left")
    tag = F.coalesce("by_key", "by_ip")
    return joined.select(*[F.col(c) for c in hosts.columns], "asset_key", *[tag[v].alias(v) for v in values])


def migrate_tags(tags: DataFrame, hosts: DataFrame, seen_at: Column) -> DataFrame:
    """Re-keys bare-IP records to the asset key of the host now at that IP.

    Records whose IP no host holds stay as they are. A migrated record replaces
    one already stored under the same asset key.
    """
    at_ip = with_asset_key(hosts).groupBy("ip").agg(F.min("asset_key").alias("new_key"))
    old = ~F.col("asset_key").rlike("^(mac|ip):")
    moved = (
        tags.where(old).join(at_ip, F.col("asset_key") == F.col("ip"), "left")
        .select(
            F.coalesce("new_key", "asset_key").alias("asset_key"), "labels",
            F.when(F.col("new_key").isNull(), F.col("owner")).alias("owner"),
            F.when(F.col("new_key").isNull(), F.col("notes")).alias("notes"),
            F.when(F.col("new_key").isNull(), F.col("last_ip")).otherwise(F.col("asset_key")).alias("last_ip"),
            F.when(F.col("new_key").isNull(), F.col("last_seen")).otherwise(seen_at).alias("last_seen"),
        )
    )
    kept = tags.where(~old).join(moved.select("asset_key"), "asset_key", "left_anti").select(*TAG_COLUMNS)
    return kept.unionByName(moved)


def upsert_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest record per asset key; on equal times a change wins over the stored record."""
    both = tags.select(*TAG_COLUMNS, F.lit(0).alias("pass")).unionByName(
        changes.select(*TAG_COLUMNS, F.lit(1).alias("pass"))
    )
    order = F.struct(F.coalesce("last_seen", F.timestamp_seconds(F.lit(0))), "pass")
    values = F.struct(*TAG_COLUMNS[1:])
    return both.groupBy("asset_key").agg(F.max_by(values, order).alias("v")).select("asset_key", "v.*")


def annotate_hosts(tags: DataFrame, hosts: DataFrame, labels: Column, owner: Column, notes: Column, seen_at: Column) -> DataFrame:
    """Sets the annotation of every host given, stamped with its current IP and time."""
    changes = with_asset_key(hosts).select(
        "asset_key", labels.alias("labels"), owner.alias("owner"), notes.alias("notes"), F.col("ip").alias("last_ip"), seen_at.alias("last_seen")
    )
    return upsert_tags(tags.join(hosts.select(F.col("ip").alias("asset_key")), "asset_key", "left_anti"), changes)


def add_label(tags: DataFrame, hosts: DataFrame, label: str, seen_at: Column) -> DataFrame:
    """Adds one label to every host given; adding it twice changes nothing."""
    target = with_asset_key(hosts).groupBy("asset_key").agg(F.max("ip").alias("new_ip"))
    joined = tags.join(target, "asset_key", "full_outer")
    hit = F.col("new_ip").isNotNull()
    none = F.array().cast("array<string>")
    return joined.select(
        "asset_key",
        F.when(hit, F.array_union(F.coalesce("labels", none), F.array(F.lit(label)))).otherwise(F.col("labels")).alias("labels"),
        "owner", "notes",
        F.coalesce("new_ip", "last_ip").alias("last_ip"),
        F.when(hit, seen_at).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def clear_tags(tags: DataFrame, hosts: DataFrame) -> DataFrame:
    """Drops the records of every host given, bare-IP records too."""
    keys = with_asset_key(hosts).select(F.explode(F.array("asset_key", "ip")).alias("asset_key"))
    return tags.join(keys, "asset_key", "left_anti").select(*tags.columns)


def host_of_tag(tags: DataFrame, hosts: DataFrame) -> DataFrame:
    """Each tag record with the host that now carries its key (lowest scan and IP if several).

    Candidates are the host's MAC key and its IP key, so a record kept under an IP
    still finds the host after its MAC became known.
    """
    keys = F.array(F.concat(F.lit("mac:"), F.upper("mac")), F.concat(F.lit("ip:"), F.col("ip")))
    host = F.struct("scan_id", "ip", "mac", "hostname")
    by_key = (
        hosts.select(F.explode(F.array_compact(keys)).alias("asset_key"), host.alias("h"))
        .groupBy("asset_key").agg(F.min("h").alias("h"))
    )
    return tags.join(by_key, "asset_key", "left").select(
        *tags.columns, F.col("h.ip").alias("host_ip"), F.col("h.mac").alias("host_mac"), F.col("h.hostname").alias("hostname")
    )


def key_terrain_report(tags: DataFrame, hosts: DataFrame) -> DataFrame:
    """Tagged or annotated assets at their current IP, else last known IP, else the key."""
    has = (F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0) | F.col("owner").isNotNull() | F.col("notes").isNotNull()
    return host_of_tag(tags.where(has), hosts).select(
        "asset_key",
        F.coalesce("host_ip", "last_ip", F.regexp_replace("asset_key", "^(mac:|ip:)", "")).alias("ip"),
        "labels", "owner", "notes",
    )


def export_tags(tags: DataFrame, hosts: DataFrame) -> DataFrame:
    """Every tag record with current host details, or the last known ones; blanks for null."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    from_key = F.when(F.col("asset_key").startswith("mac:"), F.substring("asset_key", 5, 1 << 30))
    return host_of_tag(tags, hosts).select(
        F.col("asset_key").alias("key"),
        blank(F.coalesce("host_ip", "last_ip")).alias("ip"),
        blank(F.coalesce(C.blank_to_null(F.col("host_mac")), from_key)).alias("mac"),
        blank(F.col("hostname")).alias("hostname"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        blank(F.col("owner")).alias("owner"), blank(F.col("notes")).alias("notes"), "last_seen",
    )


def label_display(tags: DataFrame) -> DataFrame:
    """One row per asset and label with the label's category and display text."""
    dim = F.broadcast(dims.tag_label_dim(tags.sparkSession))
    return (
        tags.select("asset_key", F.explode("labels").alias("label")).join(dim, "label", "left")
        .select("asset_key", "label", F.coalesce("category", F.lit("other")).alias("category"), F.coalesce("display", "label").alias("display"))
    )
