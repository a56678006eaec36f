"""Merging repeated scans of the same hosts into one inventory.

A table of observations carries ``load_ord``, the order in which scans were loaded.
The reference folds one scan at a time into a host list; each of its rules ("keep the
first", "replace by the first with a product", "higher accuracy wins") is
order-insensitive once stated over ``load_ord``, so any number of scans merge in one
pass of grouped minimums and maximums, which pre-aggregate before the shuffle.

The ``fold_`` functions keep what later folds need: folding what was folded before together with new observations gives
what folding all observations would. The import keeps its inventory in that form.

``profile`` selects between the two front ends' rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from exposure import dims

MERGED = 0


PLACES = ["load_ord", "host_ord", "port_ord", "finding_ord"]


def _places(df: DataFrame) -> list[str]:
    """Load order, then document order within a load where the reader kept it."""
    return [c for c in PLACES[:2] if c in df.columns]


#: What a host brings along from its first scan, where the reader has it.
FIRST_SEEN = ["status", "hostname", "mac", "mac_vendor", "os_fingerprint"]
OS_FIELDS = ["os_name", "os_accuracy", "os"]


def host_states(hosts: DataFrame) -> DataFrame:
    """Observations of hosts as states that :func:`fold_hosts` can fold: each rule of the merge as the value together with what
    decides for it, so that a minimum, maximum or sum of states is the state of all their observations."""
    places = _places(hosts)
    at = lambda *values: F.struct(*places, *values)
    known = lambda c, *values: F.when(F.col(c).isNotNull(), at(*values))
    have = lambda names: [c for c in names if c in hosts.columns]
    rank = (-F.coalesce("os_accuracy", F.lit(0))).alias("rank")
    states = [
        at(*have(FIRST_SEEN)).alias("first"), known("hostname", "hostname").alias("named"), known("mac", *have(["mac", "mac_vendor"])).alias("with_mac"),
        F.when(F.col("os_name").isNotNull(), F.struct(rank, *places, *have(OS_FIELDS))).alias("best_os"),
        F.coalesce(F.col("status") == "up", F.lit(False)).alias("any_up"), F.col("load_ord").alias("first_load"), F.col("load_ord").alias("last_load"),
        F.lit(1).cast("bigint").alias("sightings"),
    ]
    if "netbios_name" in hosts.columns:
        states.append(known("netbios_name", "netbios_name").alias("netbios"))
    if "credentialed_scan" in hosts.columns:
        states.append(F.coalesce("credentialed_scan", F.lit(False)).alias("credentialed_scan"))
    return hosts.select("ip", *states)


def fold_hosts(states: DataFrame) -> DataFrame:
    """One state per IP. Folding folded states with new ones gives what folding everything at once would."""
    greatest = {"any_up", "last_load", "credentialed_scan"}
    how = lambda c: F.sum(c) if c == "sightings" else F.max(c) if c in greatest else F.min(c)
    return states.groupBy("ip").agg(*[how(c).alias(c) for c in states.columns if c != "ip"])


def merged_hosts(states: DataFrame, profile: str = "web", merged_id=MERGED) -> DataFrame:
    """The host rows that folded states stand for."""
    first = states.schema["first"].dataType.names
    if dims.check_profile(profile) == "web":
        status = F.when(F.col("any_up"), "up").otherwise(F.col("first.status"))
        source = {"hostname": "first", "mac": "first", "mac_vendor": "first"}
    else:
        status = F.col("first.status")
        source = {"hostname": "named", "mac": "with_mac", "mac_vendor": "with_mac"}
    taken = lambda c: F.col(f"{source[c]}.{c}").alias(c)
    best = states.schema["best_os"].dataType.names
    out = [
        F.lit(merged_id).alias("scan_id"), F.col("ip"), taken("mac"), taken("hostname"), status.alias("status"),
        F.col("best_os.os_name").alias("os_name"), F.col("best_os.os_accuracy").alias("os_accuracy"), F.col("first_load"), F.col("last_load"), F.col("sightings"),
    ]
    out += [taken("mac_vendor")] * ("mac_vendor" in first)
    if "os" in best:
        out.append(F.coalesce("best_os.os", F.array().cast(states.schema["best_os"].dataType["os"].dataType)).alias("os"))
    out += [F.col("first.os_fingerprint").alias("os_fingerprint")] * ("os_fingerprint" in first)
    out += [F.col("netbios.netbios_name").alias("netbios_name")] * ("netbios" in states.columns)
    out += [F.col("credentialed_scan")] * ("credentialed_scan" in states.columns)
    return states.select(*out)


def merge_hosts(hosts: DataFrame, profile: str = "web", merged_id=MERGED) -> DataFrame:
    """One row per IP.

    Both profiles: the OS guess of higher accuracy wins, the earlier one on ties, and brings its list of guesses. Web: status becomes up
    once any scan saw the host up; name and MAC stay those of the first scan. Desktop: status stays that of the first scan; name and MAC are
    filled by the first scan that has them, the vendor coming along with the MAC.
    The fingerprint stays that of the first scan. NetBIOS name is the first known one, the credentialed flag any true.
    """
    return merged_hosts(fold_hosts(host_states(hosts)), profile, merged_id)


def fold_ports(ports: DataFrame, profile: str = "web") -> DataFrame:
    """The observation that stands for each IP, port and protocol, with its load and place.

    Web keeps the first observation that names a product, else the first; desktop
    always keeps the first. The order is that of loads, then of hosts and ports in their
    document where the reader kept it.
    """
    places = [c for c in PLACES if c in ports.columns]
    fields = [c for c in ports.columns if c not in ("scan_id", "ip", "port", "proto", *places)]
    rank = F.col("product").isNull() if dims.check_profile(profile) == "web" else F.lit(False)
    best = F.min(F.struct(rank.alias("rank"), *places, *fields)).alias("best")
    return ports.groupBy("ip", "port", "proto").agg(best).select("ip", "port", "proto", *[F.col(f"best.{c}").alias(c) for c in places + fields])


def merge_ports(ports: DataFrame, profile: str = "web", merged_id=MERGED) -> DataFrame:
    """One row per IP, port and protocol; see :func:`fold_ports`."""
    folded = fold_ports(ports, profile)
    return folded.select(F.lit(merged_id).alias("scan_id"), *[c for c in folded.columns if c not in PLACES])


def _first_loads(hosts: DataFrame) -> DataFrame:
    return hosts.groupBy("ip").agg(F.min("load_ord").alias("first_load"))


def merge_findings(findings: DataFrame, hosts: DataFrame, profile: str = "web", merged_id=MERGED) -> DataFrame:
    """The union of findings, without what earlier scans already reported.

    The scan that first saw a host, as a host or in a finding, contributes all its
    findings. Later scans, web: only the first finding of a (plugin, port) not seen before. Desktop: all findings
    of a plugin no earlier scan reported.

    Copies of one finding collapse in a grouped minimum, so a host re-imported many
    times does not gather in one task.
    """
    sightings = hosts.select("ip", "load_ord").unionByName(findings.select("ip", "load_ord"))
    joined = findings.join(_first_loads(sightings), "ip")
    columns = [c for c in findings.columns if c != "scan_id"]
    if dims.check_profile(profile) == "web":
        opening = joined.where(F.col("load_ord") == F.col("first_load")).select(*columns)
        later = joined.where(F.col("load_ord") > F.col("first_load"))
        places = [c for c in ("load_ord", "host_ord", "finding_ord") if c in columns]
        rest = [c for c in columns if c not in ("ip", "plugin_id", "port", *places)]
        once = later.groupBy("ip", "plugin_id", "port").agg(F.min(F.struct(*places, *[F.col(c) for c in rest])).alias("f"))
        fresh = once.join(opening.select("ip", "plugin_id", "port").distinct(), ["ip", "plugin_id", "port"], "left_anti")
        kept = opening.unionByName(fresh.select("ip", "plugin_id", "port", "f.*"))
    else:
        first = findings.groupBy("ip", "plugin_id").agg(F.min("load_ord").alias("plugin_load"))
        kept = findings.join(first, ["ip", "plugin_id"]).where(F.col("load_ord") == F.col("plugin_load")).select(*columns)
    return kept.select(F.lit(merged_id).alias("scan_id"), *columns)


def merge_cpes(host_cpes: DataFrame, merged_id=MERGED) -> DataFrame:
    """Distinct CPEs per IP, one row each, with the load that first reported it."""
    return host_cpes.groupBy("ip", "cpe").agg(F.min("load_ord").alias("first_load")).select(
        F.lit(merged_id).alias("scan_id"), "ip", "cpe", "first_load"
    )


def fold_scripts(scripts: DataFrame) -> DataFrame:
    """The result that stands for each IP, port and script, with its load and place: that of the first load which ran it."""
    places = _places(scripts)
    best = F.min(F.struct(*places, "output")).alias("best")
    return scripts.groupBy("ip", "port", "script_id").agg(best).select("ip", "port", "script_id", *[F.col(f"best.{c}").alias(c) for c in [*places, "output"]])


def merge_scripts(scripts: DataFrame, merged_id=MERGED) -> DataFrame:
    """One result per IP, port and script; see :func:`fold_scripts`."""
    return fold_scripts(scripts).select(F.lit(merged_id).alias("scan_id"), "ip", "port", "script_id", "output")


def fold_trace(trace: DataFrame, profile: str = "web") -> DataFrame:
    """The hops that stand for each IP, with their load: web those of the first load that has any, desktop the longest trace (earlier on ties)."""
    if dims.check_profile(profile) == "web":
        chosen = trace.groupBy("ip").agg(F.min("load_ord").alias("load_ord"))
    else:
        lengths = trace.groupBy("ip", "load_ord").agg(F.count(F.lit(1)).alias("n"))
        chosen = lengths.groupBy("ip").agg(F.max_by("load_ord", F.struct("n", -F.col("load_ord"))).alias("load_ord"))
    return trace.join(chosen, ["ip", "load_ord"], "left_semi").select(*[c for c in trace.columns if c != "scan_id"])


def merge_trace(trace: DataFrame, profile: str = "web", merged_id=MERGED) -> DataFrame:
    """One trace per IP; see :func:`fold_trace`."""
    folded = fold_trace(trace, profile)
    return folded.select(F.lit(merged_id).alias("scan_id"), *[c for c in folded.columns if c != "load_ord"])


def merge_os(hosts: DataFrame) -> DataFrame:
    """The winning OS guess per IP and the load it came from."""
    best = fold_hosts(host_states(hosts).select("ip", "best_os"))
    return best.select("ip", "best_os.os_name", "best_os.os_accuracy", F.col("best_os.load_ord").alias("from_load"))


def import_report(existing_hosts: DataFrame, incoming_hosts: DataFrame, incoming_findings: DataFrame | None = None) -> DataFrame:
    """One row: hosts added and updated, findings imported, and totals after the import.

    Each IP is reduced to one row saying which side holds it and whether it is up, so
    all counts come from one aggregation.
    """
    tag = lambda df, side: df.select("ip", F.lit(side).alias("side"), (F.col("status") == "up").alias("up"))
    per_ip = tag(existing_hosts, 1).unionByName(tag(incoming_hosts, 2)).groupBy("ip").agg(
        F.bit_or("side").alias("side"), F.max(F.coalesce("up", F.lit(False))).alias("up")
    )
    if incoming_findings is None:
        findings = F.lit(0).cast("bigint")
    else:
        findings = incoming_findings.agg(F.count(F.lit(1))).scalar()
    return per_ip.agg(
        F.count_if(F.col("side") == 2).alias("added"), F.count_if(F.col("side") == 3).alias("updated"),
        F.count(F.lit(1)).alias("total"), F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down"),
    ).select("*", findings.alias("findings"))


def register_sources(registry: DataFrame, hosts: DataFrame, runs: DataFrame, source_type: str) -> DataFrame:
    """The source registry with one entry appended per run: name, type, hosts, time."""
    counted = hosts.groupBy("scan_id").agg(F.count(F.lit(1)).alias("hosts"))
    new = runs.join(counted, "scan_id", "left").select(
        "scan_id", F.col("source_name").alias("name"), F.lit(source_type).alias("type"),
        F.coalesce("hosts", F.lit(0).cast("bigint")).alias("hosts"), F.col("started_at").alias("imported_at"),
    )
    return registry.unionByName(new)
