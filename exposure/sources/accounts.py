"""What the readers leave out, and why.

The readers of ``nmap`` and ``nessus`` skip elements that give no host. ``checked`` keeps every element of a report with what became of
it; ``rejects`` are those that give no row, with file, place and text, and ``observed`` counts both while a job runs, so that
an import can prove that elements = rows + rejects. ``bad_numbers`` are values that a reader replaced by its default, and
``unfinished`` are reports that lack their end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from exposure import schemas
from exposure.functions import columns as C
from exposure.sources import elements as E, nessus

PLACE = ["scan_id", "host_ord"]
#: Per scanner: the element of a host, its schema and the closing tag of a report.
REPORTS = {
    "nmap": ("host", schemas.NMAP_HOST, ["</nmaprun>"]),
    "nessus": ("ReportHost", schemas.NESSUS_HOST, ["</NessusClientData_v2>", "</NessusClientData>"]),
}


def _address(scanner: str) -> Column:
    if scanner == "nmap":
        return C.primary_ip(F.col("h.address"))
    return F.coalesce(nessus.prop("host-ip"), C.blank_to_null(F.col("h._name")))


def checked(records: DataFrame, scanner: str, xml: Column | None = None) -> DataFrame:
    """scan_id, host_ord, text, h, ip, reason of every host element; ``reason`` is null for those the reader takes, ``malformed`` for text
    that is not well formed (a report cut off inside a host, too), ``no address`` for a host that says none.

    ``records`` are as the readers split them; with ``xml`` that column holds whole elements.
    """
    name, schema, _ = REPORTS[scanner]
    if xml is None:
        records, xml = records.where(E.has_element(F.col("value"), name)), E.element(F.col("value"), name)
    parsed = records.select(*PLACE, xml.alias("text")).select("*", E.once(E.parse_checked(F.col("text"), schema)).alias("h"))
    broken = F.col("h").isNull() | F.col("h._broken").isNotNull()
    reason = F.when(broken, "malformed").when(F.col("ip").isNull(), "no address")
    return parsed.withColumn("ip", _address(scanner)).withColumn("reason", reason)


def rejects(elements: DataFrame) -> DataFrame:
    """scan_id, host_ord, reason, text of the elements that give no row."""
    return elements.where(F.col("reason").isNotNull()).select(*PLACE, "reason", "text")


def accepted(elements: DataFrame) -> DataFrame:
    """The nested hosts among ``checked`` elements, as the scanner's ``parse`` gives them."""
    return elements.where(F.col("reason").isNull()).select(*PLACE, "ip", F.col("h").dropFields("_broken").alias("h"))


def observed(elements: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``elements`` with counters that the next job over them fills: elements, rows, malformed and without_address. Write the elements
    once, observed, and derive rows and rejects from what was written."""
    seen = Observation(name)
    of = lambda reason: F.count_if(F.col("reason") == reason)
    counters = [F.count(F.lit(1)).alias("elements"), F.count_if(F.col("reason").isNull()).alias("rows"), of("malformed").alias("malformed"), of("no address").alias("without_address")]
    return elements.observe(seen, *counters), seen


def report_accounts(elements: DataFrame) -> DataFrame:
    """Per report: elements, rows, malformed, without_address."""
    of = lambda reason: F.count_if(F.col("reason") == reason)
    return elements.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("elements"), F.count_if(F.col("reason").isNull()).alias("rows"), of("malformed").alias("malformed"), of("no address").alias("without_address"),
    )


def unfinished(records: DataFrame, scanner: str) -> DataFrame:
    """scan_id of reports without their closing tag, whose last host may lack a part even if it reads well."""
    ends = reduce(Column.__or__, [F.col("value").contains(tag) for tag in REPORTS[scanner][2]])
    return records.groupBy("scan_id").agg(F.max(ends).alias("ended")).where(~F.col("ended")).select("scan_id")


def bad_numbers(nested: DataFrame, scanner: str) -> DataFrame:
    """scan_id, host_ord, ip, field, value: texts where a number belongs, for which the reader takes its default. Blanks are none."""
    number = lambda field, value, kind="int": F.when(
        C.blank_to_null(F.trim(value)).isNotNull() & F.trim(value).try_cast(kind).isNull(), F.struct(F.lit(field).alias("field"), value.alias("value"))
    )
    of = lambda items, test: F.transform(F.coalesce(items, F.array()), test)
    if scanner == "nmap":
        found = [
            of(F.col("h.ports.port"), lambda p: number("port", p["_portid"])), of(F.col("h.os.osmatch"), lambda m: number("accuracy", m["_accuracy"])),
            of(F.col("h.trace.hop"), lambda t: number("ttl", t["_ttl"])),
        ]
    else:
        item = lambda field, name, kind="int": of(F.col("h.ReportItem"), lambda i: number(field, i[name], kind))
        found = [
            item("port", "_port"), item("severity", "_severity"), item("plugin", "_pluginID"), item("cvss", "cvss_base_score", "double"),
            item("cvss3", "cvss3_base_score", "double"), F.array(number("os_confidence", nessus.prop("operating-system-conf"))),
        ]
    bad = F.array_compact(F.concat(*found))
    return nested.select(*PLACE, "ip", F.explode(bad).alias("b")).select(*PLACE, "ip", "b.field", "b.value")
