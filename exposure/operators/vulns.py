"""CVE matching by CPE, and roll-ups over scanner findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from exposure.functions import columns as C
from exposure.operators.topk import top_n_per_group

KEY = C.HOST_KEY


def _first_port(ports: DataFrame) -> DataFrame:
    """Per host and CPE, the lowest open port carrying it."""
    carrying = ports.where((F.col("state") == "open") & F.col("cpe").isNotNull()).select(*KEY, "cpe", "port")
    return carrying.groupBy(*KEY, "cpe").agg(F.min("port").alias("port"))


def match_exact(ports: DataFrame, vuln_db: DataFrame) -> DataFrame:
    """Database rows whose CPE equals the CPE of an open port, per host, CPE and CVE."""
    db = vuln_db.select("cpe", "ord", "cve", "cvss", "descr")
    return _first_port(ports).join(db, "cpe").select(*KEY, "port", "cpe", "ord", "cve", "cvss", "descr")


def cpe_pairs(cpes: DataFrame, vuln_db: DataFrame, mode: str = "normalized") -> DataFrame:
    """Which database CPEs a port CPE reaches: ``cpe``, ``db_cpe``, ``match``.

    ``literal`` tests whether the database CPE starts with the first five ``:`` parts
    of the port CPE, as text, so ``prod1`` reaches ``prod10``. Each database CPE is cut to every length that such a prefix has in the data (few:
    names are short) and the prefixes are met by equality, so the rows that meet are the matches, however many CPEs a
    vendor has. Cut, the database is far larger than the file whose size Spark goes by, so it is joined by sorting and never
    broadcast. ``normalized`` writes 2.2 CPEs in 2.3 form and requires
    the same part, vendor and product.

    Both sides are distinct CPEs, so the pairing does not grow with the ports.
    """
    cpes = cpes.select("cpe").distinct()
    db = vuln_db.select(F.col("cpe").alias("db_cpe")).distinct()
    if mode == "literal":
        left = cpes.select("cpe", C.cpe_base(F.col("cpe")).alias("base"))
        lengths = left.agg(F.collect_set(F.length("base"))).scalar()
        cut = db.select("db_cpe", lengths.alias("lengths")).select("db_cpe", F.explode("lengths").alias("n")).where("n <= length(db_cpe)")
        joined = left.join(cut.select("db_cpe", F.expr("substring(db_cpe, 1, n)").alias("base")).hint("merge"), "base")
        kind = F.when(F.col("cpe") == F.col("db_cpe"), "exact").otherwise("prefix")
    elif mode == "normalized":
        product = lambda c: C.cpe_base(C.cpe_23(F.col(c)))
        named = lambda c: F.size(F.split(C.cpe_23(F.col(c)), ":")) >= 5
        left = cpes.where(named("cpe")).withColumn("stem", product("cpe"))
        right = db.where(named("db_cpe")).withColumn("stem", product("db_cpe"))
        joined = left.join(right, "stem")
        version = lambda c: C.cpe_version(C.cpe_23(F.col(c)))
        same = (F.col("cpe") == F.col("db_cpe")) | version("cpe").eqNullSafe(version("db_cpe"))
        kind = F.when(same, "exact").otherwise("prefix")
    else:
        raise ValueError(f"mode must be 'literal' or 'normalized', got {mode!r}")
    return joined.select("cpe", "db_cpe", kind.alias("match"))


def _best_per_cpe(cpes: DataFrame, vuln_db: DataFrame, mode: str) -> DataFrame:
    """Per port CPE and CVE, the row reported for it: exact CPE first, then database order."""
    db = vuln_db.where(F.col("cve").isNotNull()).select(F.col("cpe").alias("db_cpe"), "ord", "cve", "cvss", "descr")
    rank = (F.col("match") != "exact").alias("rank")
    return (
        cpe_pairs(cpes, vuln_db, mode).join(db.hint("merge"), "db_cpe")
        .groupBy("cpe", "cve").agg(F.min(F.struct(rank, "db_cpe", "ord", "cvss", "descr")).alias("hit"))
    )


def _match_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *KEY, "cve", F.col("hit.cvss").alias("cvss"), C.cvss_class(F.col("hit.cvss")).alias("cvss_class"), "port",
        F.col("hit.db_cpe").alias("cpe"), F.when(F.col("hit.rank"), "prefix").otherwise("exact").alias("match"), F.col("hit.descr").alias("descr"),
    )


def _first_per_cve(df: DataFrame) -> DataFrame:
    best = df.groupBy(*KEY, "cve").agg(F.min(F.struct("port", "hit")).alias("best"))
    return best.select(*KEY, "cve", "best.port", "best.hit")


def match_cves(ports: DataFrame, vuln_db: DataFrame, mode: str = "normalized") -> DataFrame:
    """Each CVE once per host: lowest port first, exact CPE before prefix, then database order.

    Distinct CPEs are matched first and reduced to one row per CPE and CVE, so the
    many-to-many step runs on the catalogue and not on the fleet.

    In normalized mode every CPE of a product reaches the same CVEs, so a host needs
    only the CPEs at its lowest port of that product, and a CVE listed under a single product
    can reach it once only. Those rows, nearly all, leave the join as they are;
    only CVEs of several products, and ports with several CPEs of one product, are
    grouped to find the first. In literal mode it is a CVE listed under a single database CPE, and a port
    CPE that no other one of the host reaches a common database CPE with, that need no grouping.
    """
    opened = _open_cpes(ports)
    pairs = lambda rows: rows.select(*KEY, "cve", "port", "hit")
    known = _known(opened, vuln_db, mode)
    if mode != "normalized":
        on_host = _apart(opened)
        apart = on_host.where("apart")
        several = pairs(apart.join(known.where("not one_product"), "cpe")).unionByName(pairs(on_host.where("not apart").join(known, "cpe")))
        return _match_columns(pairs(apart.join(known.where("one_product"), "cpe")).unionByName(_first_per_cve(several)))
    matched = _lowest(opened).join(known, "cpe")
    alone = F.col("single") & F.col("one_product")
    return _match_columns(pairs(matched.where(alone)).unionByName(_first_per_cve(pairs(matched.where(~alone)))))


def _open_cpes(ports: DataFrame) -> DataFrame:
    return ports.where((F.col("state") == "open") & F.col("cpe").isNotNull()).select(*KEY, "cpe", "port")


def _product(cpe: str) -> Column:
    """Part, vendor and product of a CPE in 2.3 form, which is all that normalized matching compares."""
    return C.cpe_base(C.cpe_23(F.col(cpe)))


def _lowest(opened: DataFrame) -> DataFrame:
    """Per host and product the CPEs at its lowest port; ``single`` where that is one."""
    on_host = opened.groupBy(*KEY, "cpe").agg(F.min("port").alias("port"))
    return (
        on_host.groupBy(*KEY, _product("cpe").alias("stem"), "port").agg(F.collect_set("cpe").alias("cpes"))
        .groupBy(*KEY, "stem").agg(F.min(F.struct("port", "cpes")).alias("at"))
        .select(*KEY, F.col("at.port").alias("port"), (F.size("at.cpes") == 1).alias("single"), F.explode("at.cpes").alias("cpe"))
    )


def _apart(opened: DataFrame) -> DataFrame:
    """Per host and CPE its lowest port; ``apart`` where no other CPE of the host reaches a database CPE that this one reaches by the
    literal rule, as neither base begins with the other.

    In byte order a base is followed by what begins with it, up to the base with a byte that no text has.
    """
    on_host = opened.repartition(*KEY).groupBy(*KEY, "cpe").agg(F.min("port").alias("port")).withColumn("base", C.cpe_base(F.col("cpe")))
    base, in_order = F.col("base"), Window.partitionBy(*KEY).orderBy("base")
    ends = F.max(F.concat(base.cast("binary"), F.lit(b"\xff"))).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    leads, follows = F.startswith(F.lead("base").over(in_order), base), ends > base.cast("binary")
    related = F.coalesce(leads, F.lit(False)) | F.coalesce(follows, F.lit(False))
    return on_host.select(*KEY, "cpe", "port", (~related).alias("apart"))


def _known(opened: DataFrame, vuln_db: DataFrame, mode: str = "normalized") -> DataFrame:
    """What is reported for each port CPE and CVE; ``one_product`` where the CVE is listed under one product only (literal: one CPE)."""
    stem = _product("cpe") if mode == "normalized" else F.col("cpe")
    products = (
        vuln_db.where(F.col("cve").isNotNull()).groupBy("cve", stem.alias("stem")).agg(F.lit(1).alias("one"))
        .groupBy("cve").agg((F.count(F.lit(1)) == 1).alias("one_product"))
    )
    return _best_per_cpe(opened, vuln_db, mode).join(products, "cve")


def _stem() -> Column:
    """The product of a CPE, null if it names none."""
    return F.when(F.size(F.split(C.cpe_23(F.col("cpe")), ":")) >= 5, _product("cpe"))


def open_products(ports: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Distinct hosts and products on their open ports: ``stem``."""
    opened = _open_cpes(ports)
    return opened.select(*keys, _stem().alias("stem")).where("stem IS NOT NULL").distinct()


def cve_classes(vuln_db: DataFrame) -> DataFrame:
    """cve, class, products: CVEs listed under the same products are one class, known by its smallest CVE. Whatever a host has open, it has all
    CVEs of a class or none, so hosts meet classes instead of CVEs."""
    listed = vuln_db.where(F.col("cve").isNotNull()).select("cve", _stem().alias("stem")).where("stem IS NOT NULL")
    per_cve = listed.distinct().groupBy("cve").agg(F.array_sort(F.collect_set("stem")).alias("products"))
    return per_cve.groupBy("products").agg(F.min("cve").alias("class"), F.collect_list("cve").alias("cves"))


def class_products(vuln_db: DataFrame) -> DataFrame:
    """stem, class, cves: the classes of each product and how many CVEs they have."""
    return cve_classes(vuln_db).select(F.explode("products").alias("stem"), "class", F.size("cves").cast("bigint").alias("cves"))


def count_cves(ports: DataFrame, vuln_db: DataFrame) -> DataFrame:
    """Per host how many CVEs its open ports match (normalized), without a row per host and CVE."""
    met = open_products(ports).join(class_products(vuln_db), "stem")
    return met.groupBy(*KEY, "class").agg(F.max("cves").alias("cves")).groupBy(*KEY).agg(F.sum("cves").alias("cves"))


def hosts_matching(ports: DataFrame, vuln_db: DataFrame) -> DataFrame:
    """Hosts with an open port whose product has any CVE of the database (normalized)."""
    listed = vuln_db.where(F.col("cve").isNotNull()).select(_stem().alias("stem")).distinct()
    return _open_cpes(ports).select(*KEY, _stem().alias("stem")).join(listed, "stem", "left_semi").select(*KEY).distinct()


def top_cves(ports: DataFrame, vuln_db: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` CVEs of highest CVSS per host as :func:`match_cves` reports them (normalized), their ``rank``, and how many ``more`` there are.

    A CVE of a single product comes to a host through one CPE, so of those a CPE hands on its first ``n`` only.
    """
    opened = _open_cpes(ports)
    lowest, known = _lowest(opened), _known(opened, vuln_db)
    order = [F.desc("hit.cvss"), F.asc("cve")]
    first = top_n_per_group(known.where("one_product"), ["cpe"], order, n).select("cpe", "cve", "hit")
    pairs = lambda rows: rows.select(*KEY, "cve", "port", "hit")
    alone = pairs(lowest.where("single").join(first, "cpe"))
    # All CPEs of a product reach the same CVEs, so what is left are CVEs of several products and hosts with several CPEs at a port.
    rest = lowest.where("single").join(known.where("not one_product"), "cpe").select(*KEY, "cve", "port", "hit")
    several = lowest.where("not single").join(known, "cpe").select(*KEY, "cve", "port", "hit")
    found = _match_columns(alone.unionByName(_first_per_cve(rest.unionByName(several))))
    shown = top_n_per_group(found, KEY, [F.desc("cvss"), F.asc("cve")], n).join(count_cves(ports, vuln_db), KEY)
    return shown.withColumn("more", F.greatest(F.col("cves") - n, F.lit(0).cast("bigint"))).drop("cves")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per severity label."""
    return findings.groupBy(C.severity_label(F.col("severity")).alias("severity_label")).agg(F.count(F.lit(1)).alias("findings"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row: findings by severity, exploitable findings, affected hosts.

    Reduced to one row per host first, which makes the distinct count of hosts a plain count.
    """
    sev = F.col("severity")
    names = {"critical": 4, "high": 3, "medium": 2, "low": 1}
    per_host = findings.groupBy("ip").agg(
        *[F.count_if(sev == v).alias(n) for n, v in names.items()],
        F.count_if(F.col("exploit_available")).alias("exploitable"), F.count(F.lit(1)).alias("findings"),
    )
    return per_host.agg(
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in [*names, "exploitable", "findings"]],
        F.count(F.lit(1)).alias("hosts_affected"),
    )


PLUGIN_FIELDS = [
    "plugin_name", "severity", "severity_label", "cvss", "cvss3", "exploit_available", "cves", "risk_factor", "vpr", "synopsis", "description",
    "solution", "stig_severity", "refs", "xrefs",
]


def _document_order(findings: DataFrame) -> list[Column]:
    """What orders findings as their reports list them: load or scan, host, item."""
    load = "load_ord" if "load_ord" in findings.columns else "scan_id"
    host = "host_ord" if "host_ord" in findings.columns else "ip"
    return [F.col(load).alias("o1"), F.col(host).alias("o2"), F.col("finding_ord").alias("o3")]


def vulnerability_rollup(findings: DataFrame) -> DataFrame:
    """Per plugin: details of its first finding, affected entries, distinct hosts.

    The first finding is that of the earliest load, there of the first host and item; its
    details are the whole plugin record as far as the reader has it. The affected hosts themselves are :func:`affected_hosts`, a long table: one plugin may
    touch every host.
    """
    fields = [c for c in PLUGIN_FIELDS if c in findings.columns]
    first = F.min(F.struct(*_document_order(findings), *[F.col(c) for c in fields])).alias("first")
    per_host = findings.groupBy("plugin_id", "ip").agg(F.count(F.lit(1)).alias("n"), first)
    return (
        per_host.groupBy("plugin_id")
        .agg(F.sum("n").alias("entries"), F.count(F.lit(1)).alias("hosts"), F.min("first").alias("first"))
        .select("plugin_id", *[F.col(f"first.{c}").alias(c) for c in fields], "entries", "hosts")
    )


def affected_hosts(findings: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """One row per plugin, host and port, with the plugin's first output there if the reader has it, and
    the host name where ``hosts`` is given."""
    output = []
    if "output" in findings.columns:
        output = [F.min_by("output", F.when(F.col("output").isNotNull(), F.struct(*_document_order(findings)))).alias("output")]
    rows = findings.groupBy("plugin_id", "scan_id", "ip", "port").agg(F.count(F.lit(1)).alias("entries"), *output)
    if hosts is None:
        return rows
    return rows.join(hosts.select(*KEY, "hostname"), KEY, "left").select(
        "plugin_id", "scan_id", "ip", "hostname", "port", "entries", *[c for c in rows.columns if c == "output"]
    )


def rollup_summary(findings: DataFrame) -> DataFrame:
    """One row: unique plugins in all and per severity, and distinct hosts.

    A plugin counts under the severity of its first finding.
    """
    names = {"critical": 4, "high": 3, "medium": 2, "low": 1}
    plugins = findings.groupBy("plugin_id").agg(F.min(F.struct(*_document_order(findings), "severity")).getField("severity").alias("severity"))
    by_plugin = plugins.agg(
        F.count(F.lit(1)).alias("plugins"), *[F.count_if(F.col("severity") == v).alias(n) for n, v in names.items()]
    )
    hosts = findings.groupBy("ip").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n")).scalar()
    return by_plugin.select("*", hosts.alias("hosts"))


def common_vulnerabilities(rollup: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` plugins with the highest severity, then the most entries."""
    return rollup.orderBy(F.desc("severity"), F.desc("entries"), "plugin_id").limit(n).select(
        "plugin_id", "plugin_name", "severity", "severity_label", "cvss3", "entries"
    )


def sort_rollup(rollup: DataFrame, by: str = "severity", n: int = 100) -> DataFrame:
    """The first ``n`` plugins by ``severity``, ``hosts`` or ``cvss``."""
    orders = {
        "severity": [F.desc("severity"), F.desc("entries")],
        "hosts": [F.desc("entries"), F.desc("severity")],
        "cvss": [F.desc(F.coalesce(F.nullif("cvss3", F.lit(0.0)), "cvss", F.lit(0.0)))],
    }
    return rollup.orderBy(*orders[by], "plugin_id").limit(n)


def vuln_db_stats(vuln_db: DataFrame) -> DataFrame:
    """One row: CPEs, mappings and unique CVEs."""
    cves = vuln_db.where(F.col("cve").isNotNull()).groupBy("cve").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)).alias("n")).scalar()
    per_cpe = vuln_db.groupBy("cpe").agg(F.count("cve").alias("n"))
    return per_cpe.agg(F.count(F.lit(1)).alias("cpes"), F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("mappings")).select(
        "*", cves.alias("unique_cves")
    )
