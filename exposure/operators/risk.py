"""Port risk, host risk scores, dashboard totals and the riskiest hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from exposure import dims
from exposure.functions import columns as C, risk as R

KEY = C.HOST_KEY
PORT_WEIGHTS = R.port_score_weights()
FINDING_WEIGHTS = R.finding_score_weights()


def with_port_risk(ports: DataFrame, profile: str = "web") -> DataFrame:
    """Adds ``risk_weight``, ``is_cleartext``, ``cleartext_name`` and ``score_weight``.

    The web profile looks service names up as written, the desktop profile in
    lower case. Both tables are constants, so both joins are broadcast.
    """
    spark = ports.sparkSession
    dims.check_profile(profile)
    svc = F.col("svc") if profile == "web" else F.lower("svc")
    out = (
        ports.withColumn("svc_key", svc)
        .join(F.broadcast(dims.port_dim(spark, profile)), "port", "left")
        .join(F.broadcast(dims.service_dim(spark, profile)), "svc_key", "left")
    )
    weight = F.greatest(F.coalesce("port_weight", F.lit(0)), F.coalesce("svc_weight", F.lit(0)))
    name = F.coalesce("port_cleartext", "svc_cleartext")
    return out.select(
        *[F.col(c) for c in ports.columns],
        weight.alias("risk_weight"),
        name.isNotNull().alias("is_cleartext"),
        name.alias("cleartext_name"),
        (weight + F.when(name.isNotNull(), dims.CLEARTEXT_BONUS).otherwise(0)).alias("score_weight"),
    )


def port_profile(ports: DataFrame, profile: str = "web") -> DataFrame:
    """Per host: port counts, the counters for scoring, and the heaviest port.

    Every aggregate has a fixed-width buffer, so this is one hash aggregation with
    a map-side combine. The heaviest port (lowest number on ties) travels packed
    with its weight in one integer for the same reason.
    """
    is_open, weight = F.col("state") == "open", F.col("open_weight")
    facts = with_port_risk(ports, profile).withColumn("open_weight", F.when(is_open, F.col("score_weight")))
    packed = F.when(weight > 0, weight * 65536 + (65535 - F.col("port")))
    return facts.groupBy(*KEY).agg(
        F.count_if(is_open).alias("open_ports"),
        F.count_if(F.col("state") == "filtered").alias("filtered_ports"),
        F.count_if(is_open & F.col("is_cleartext")).alias("cleartext_ports"),
        F.max(packed).alias("top_port_packed"),
        *R.weight_counters("open_weight", PORT_WEIGHTS, "pw"),
    )


def finding_profile(findings: DataFrame) -> DataFrame:
    """Per host: finding counts by severity and the counters for scoring."""
    sev, exploit = F.col("severity"), F.coalesce("exploit_available", F.lit(False))
    linear = F.when(sev.isin(*dims.SEVERITY_RISK), F.col("weight")).otherwise(0)
    return findings.withColumn("weight", R.finding_weight(sev, exploit)).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(sev == 4).alias("critical_findings"),
        F.count_if(sev == 3).alias("high_findings"),
        F.count_if(sev == 2).alias("medium_findings"),
        F.count_if(sev == 1).alias("low_findings"),
        F.sum(linear).alias("linear_risk"),
        *R.weight_counters("weight", FINDING_WEIGHTS, "fw"),
    )


COUNTS = [
    "open_ports", "filtered_ports", "cleartext_ports", "findings",
    "critical_findings", "high_findings", "medium_findings", "low_findings",
]


def score_hosts(
    hosts: DataFrame, ports: DataFrame, findings: DataFrame | None = None, profile: str = "web"
) -> DataFrame:
    """Every host with ``risk`` (0..100), its port and finding counts and heaviest port.

    Web findings risk has diminishing returns like port risk; desktop findings risk
    is a plain sum. The children are aggregated to one row per host before the join.
    """
    dims.check_profile(profile)
    out = hosts.join(port_profile(ports, profile), KEY, "left")
    if findings is not None:
        out = out.join(finding_profile(findings), KEY, "left")
    else:
        out = out.select(
            "*", *[F.lit(None).cast("bigint").alias(c) for c in COUNTS if c not in out.columns],
            F.lit(None).cast("bigint").alias("linear_risk"),
            *[F.lit(None).cast("bigint").alias(f"fw{w}") for w in FINDING_WEIGHTS],
        )
    port_risk = R.diminishing_sum(PORT_WEIGHTS, "pw", "harmonic")
    if profile == "web":
        finding_risk = R.diminishing_sum(FINDING_WEIGHTS, "fw", "harmonic")
    else:
        finding_risk = F.coalesce("linear_risk", F.lit(0)).cast("double")
    packed = F.col("top_port_packed")
    return out.withColumn("harmonic", R.harmonic_column()).select(
        *[F.col(c) for c in hosts.columns],
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in COUNTS],
        (65535 - packed % 65536).cast("int").alias("top_port"),
        R.final_score(port_risk, finding_risk, profile).alias("risk"),
    )


def dashboard_totals(scored: DataFrame, profile: str = "web") -> DataFrame:
    """Per scan: hosts, hosts up, open ports, cleartext services and average risk.

    Web counts cleartext and averages risk over up hosts with a positive score,
    rounded; desktop sums all hosts and divides by the up hosts, truncated.
    """
    up = F.col("status") == "up"
    if dims.check_profile(profile) == "web":
        scored_up = up & (F.col("risk") > 0)
        cleartext = F.sum(F.when(up, F.col("cleartext_ports")).otherwise(0))
        average = F.coalesce(F.round(F.sum(F.when(scored_up, F.col("risk"))) / F.nullif(F.count_if(scored_up), F.lit(0)), 0), F.lit(0))
    else:
        cleartext = F.sum("cleartext_ports")
        average = F.coalesce(F.floor(F.sum("risk") / F.nullif(F.count_if(up), F.lit(0))), F.lit(0))
    return scored.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("hosts"),
        F.count_if(up).alias("hosts_up"),
        F.sum("open_ports").alias("open_ports"),
        cleartext.alias("cleartext_services"),
        average.cast("int").alias("average_risk"),
    )


def leading_reason(scored: DataFrame) -> DataFrame:
    """Adds ``reason``: critical findings, else high findings, else the heaviest port."""
    reason = (
        F.when(F.col("critical_findings") > 0, F.concat(F.col("critical_findings").cast("string"), F.lit(" critical vulns")))
        .when(F.col("high_findings") > 0, F.concat(F.col("high_findings").cast("string"), F.lit(" high vulns")))
        .when(F.col("top_port").isNotNull(), F.concat(F.lit("Port "), F.col("top_port").cast("string")))
        .otherwise("Multiple factors")
    )
    return scored.withColumn("reason", reason)


def top_risky_hosts(scored: DataFrame, n: int = 5, profile: str = "web") -> DataFrame:
    """The ``n`` riskiest hosts; ties go to the lower scan and IP.

    Web considers up hosts with a positive score, desktop all hosts.
    """
    if dims.check_profile(profile) == "web":
        scored = scored.where((F.col("status") == "up") & (F.col("risk") > 0))
    return (
        leading_reason(scored)
        .select("scan_id", "ip", "hostname", "risk", C.risk_level(F.col("risk")).alias("level"), "reason")
        .orderBy(F.desc("risk"), "scan_id", "ip")
        .limit(n)
    )


def weight_ranks(ports: DataFrame, profile: str = "web") -> DataFrame:
    """Diminishing-returns ranks per host, run-length encoded.

    One row per host and weight: the weight holds ranks ``first_rank`` to
    ``last_rank`` of the host's open ports, heaviest first, and adds
    ``contribution`` to the port risk, which has no cap here: every rank adds its part. A
    host has at most as many rows as there are distinct weights, so the window partition
    is bounded whatever the port count.
    """
    counts = (
        with_port_risk(ports, profile)
        .where((F.col("state") == "open") & (F.col("score_weight") > 0))
        .groupBy(*KEY, "score_weight").agg(F.count(F.lit(1)).alias("n"))
    )
    heavier_first = Window.partitionBy(*KEY).orderBy(F.desc("score_weight")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last = F.sum("n").over(heavier_first)
    before = F.col("last_rank") - F.col("n")
    gain = F.expr("aggregate(sequence(last_rank - n + 1, last_rank), 0D, (a, k) -> a + 1D / log2(k + 1))")
    return counts.withColumn("last_rank", last).select(
        *KEY, "score_weight", (before + 1).alias("first_rank"), "last_rank",
        F.round(F.col("score_weight") * gain, 6).alias("contribution"),
    )
