"""Scalar column expressions: identity, classification, subnets and CPE names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from exposure import dims

HOST_KEY = ["scan_id", "ip"]
SUBNET_MASKS = (8, 16, 20, 24, 28)


def blank_to_null(col: Column) -> Column:
    """Scanner output writes an absent value as ``''``; tables store null."""
    return F.nullif(col, F.lit(""))


def case_of(col: Column, mapping: Mapping, default=None) -> Column:
    """``CASE col WHEN key THEN value ... ELSE default END``."""
    out = None
    for key, value in mapping.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out.otherwise(default) if default is not None else out


def asset_key(mac: Column, ip: Column) -> Column:
    """Stable identity of an asset: its MAC where known, else its IP."""
    return F.when(
        mac.isNotNull() & (mac != ""), F.concat(F.lit("mac:"), F.upper(mac))
    ).otherwise(F.concat(F.lit("ip:"), ip))


def primary_address(addresses: Column, kind: str) -> Column:
    """First ``address`` element of an XML host with the given ``addrtype``."""
    return F.get(F.filter(addresses, lambda a: a["_addrtype"] == kind), F.lit(0))


def primary_ip(addresses: Column) -> Column:
    """The IPv4 address, else the IPv6 address."""
    return F.coalesce(
        blank_to_null(primary_address(addresses, "ipv4")["_addr"]),
        blank_to_null(primary_address(addresses, "ipv6")["_addr"]),
    )


def best_os(os_matches: Column) -> Column:
    """The first operating-system guess; scanners list the best one first."""
    return F.get(os_matches, F.lit(0))


def severity_label(severity: Column) -> Column:
    return case_of(severity, dims.SEVERITY_LABELS, "Unknown")


def os_class(os_name: Column, profile: str = "web") -> Column:
    """windows / linux / network / unknown, first matching pattern wins."""
    name = F.lower(F.coalesce(os_name, F.lit("")))
    out = None
    for label, pattern in dims.OS_PATTERNS[dims.check_profile(profile)]:
        hit = name.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unknown")


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 70, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")
    )


def cvss_class(cvss: Column) -> Column:
    return (
        F.when(cvss >= 9.0, "critical").when(cvss >= 7.0, "high").when(cvss >= 4.0, "medium").otherwise("low")
    )


def subnet_key(ip: Column, cidr: int = 24) -> Column:
    """Network address of a dotted IPv4 address, such as ``10.1.192.0/20``; else ``other``."""
    parts = F.split(ip, r"\.")
    octet = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    number = octet[0] * (1 << 24) + octet[1] * (1 << 16) + octet[2] * (1 << 8) + octet[3]
    network = number.bitwiseAND(F.lit((0xFFFFFFFF << (32 - cidr)) & 0xFFFFFFFF).cast("bigint"))
    dotted = F.concat_ws(
        ".",
        *[F.shiftright(network, shift).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for shift in (24, 16, 8, 0)],
    )
    return F.when(
        (F.size(parts) == 4) & number.isNotNull(), F.concat(dotted, F.lit(f"/{cidr}"))
    ).otherwise("other")


def subnet_hosts(mask: int) -> int:
    """Usable addresses of a subnet."""
    return 2 ** (32 - mask) - 2


def subnet_networks(mask: int) -> float:
    """How many such subnets a /16 holds."""
    return 2.0 ** (mask - 16)


def cpe_base(cpe: Column) -> Column:
    """The first five ``:`` parts of a CPE."""
    return F.array_join(F.slice(F.split(cpe, ":"), 1, 5), ":")


def cpe_23(cpe: Column) -> Column:
    """A CPE 2.2 URI (``cpe:/a:v:p:1``) in 2.3 form (``cpe:2.3:a:v:p:1``)."""
    return F.regexp_replace(cpe, "^cpe:/", "cpe:2.3:")


def cpe_version(cpe23: Column) -> Column:
    """Version part of a 2.3 CPE; null where absent or a wildcard."""
    version = F.get(F.split(cpe23, ":"), F.lit(5))
    return F.when(version.isin("", "*", "-"), None).otherwise(version)


def csv_field(col: Column, quote_all: bool = False) -> Column:
    """One CSV field: quotes doubled, and quoted when needed (or always)."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    if quote_all:
        return quoted
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def csv_line(cols: list[Column], quote_all: bool = False) -> Column:
    return F.concat_ws(",", *[csv_field(c, quote_all) for c in cols])
