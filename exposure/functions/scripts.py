"""Field extraction from scanner script output and fingerprints, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from exposure import dims


def lines(output: Column) -> Column:
    return F.split(output, r"\r?\n")


def after_label(output: Column, label: str, any_case: bool = False) -> Column:
    """What follows ``label`` on the first line that has it with something behind it, trimmed; null without one."""
    plain = (lambda c: F.lower(c)) if any_case else (lambda c: c)
    key = label.lower() if any_case else label
    rest = F.transform(lines(output), lambda x: F.when(F.instr(plain(x), key) > 0, F.substring(x, F.instr(plain(x), key) + len(label), F.length(x))))
    return F.trim(F.get(F.filter(rest, lambda x: F.length(x) > 0), F.lit(0)))


def first_item(value: Column) -> Column:
    """A value up to the gap of two spaces that ends it in one-line output."""
    return F.trim(F.get(F.split(value, "  "), F.lit(0)))


def day(value: Column) -> Column:
    """The date a value begins with, as text; null if it begins with something else."""
    head = F.substring(value, 1, 10)
    return F.when(F.translate(head, "0123456789", "9" * 10) == "9999-99-99", head)


def is_vulnerability(script_id: Column) -> Column:
    """Whether the id holds one of the vulnerability markers."""
    return script_id.rlike("|".join(dims.VULN_SCRIPT_MARKERS))


def _labelled(script: str, name: str, any_case: bool = False):
    return lambda o: after_label(o, dims.SCRIPT_LABELS[script][name], any_case)


def _title(output: Column) -> Column:
    label = dims.SCRIPT_LABELS["http-title"]["title"]
    return F.trim(F.when(output.startswith(label), F.ltrim(F.substring(output, F.lit(len(label) + 1), F.length(output)))).otherwise(output))


# script id -> (finding type, {field: expression of the output})
PARSERS = {
    "ssl-cert": ("cert", {
        "subject": lambda o: first_item(_labelled("ssl-cert", "subject")(o)), "issuer": lambda o: first_item(_labelled("ssl-cert", "issuer")(o)),
        "expires": lambda o: day(_labelled("ssl-cert", "expires")(o)),
    }),
    "http-title": ("http", {"title": _title}),
    "http-server-header": ("http", {"server": F.trim}),
    "smb-os-discovery": ("smb", {name: _labelled("smb-os-discovery", name) for name in ("os", "computer", "domain")}),
    "ssh-hostkey": ("ssh", {}),
    "ftp-anon": ("ftp", {}),
    "ms-sql-info": ("mssql", {name: _labelled("ms-sql-info", name, any_case=True) for name in ("version", "instance")}),
    "mysql-info": ("mysql", {"version": _labelled("mysql-info", "version")}),
}
FIELDS = ["subject", "issuer", "expires", "title", "server", "os", "computer", "domain", "version", "instance"]


def finding_type(script_id: Column) -> Column:
    out = None
    for name, (kind, _) in PARSERS.items():
        out = F.when(script_id == name, kind) if out is None else out.when(script_id == name, kind)
    return out


def field(name: str, script_id: Column, output: Column) -> Column:
    """The named field, from whichever parser of this script id yields it."""
    out = None
    for script, (_, parse) in PARSERS.items():
        if name in parse:
            value = parse[name](output)
            out = F.when(script_id == script, value) if out is None else out.when(script_id == script, value)
    return out


def ssh_keys(output: Column, first: int = 3) -> Column:
    """The first keys as (bits, algo, fingerprint shortened to 16 characters and ``...``)."""
    fields = F.transform(lines(output), lambda x: F.filter(F.split(x, r"\s+"), lambda f: ~f.isin("", "|", "|_")))
    is_key = lambda f: (F.size(f) >= 3) & (F.translate(f[0], "0123456789", "") == "") & (F.regexp_replace(f[1], r"[\w-]", "") == "")
    return F.transform(
        F.slice(F.filter(fields, is_key), 1, first),
        lambda f: F.struct(f[0].alias("bits"), f[1].alias("algo"), F.concat(F.substring(f[2], 1, 16), F.lit("...")).alias("fingerprint")),
    )


def is_anonymous(output: Column) -> Column:
    return F.lower(output).contains("anonymous ftp login allowed")


def fingerprint_sections(fingerprint: Column) -> Column:
    """``SECTION(K=V%K=V)`` text as an array of (section, body).

    The text is taken as it stands: it holds ``%`` as a separator, so decoding it as
    a URL fails.
    """
    cut = F.transform(F.split(fingerprint, r"\)"), lambda x: F.split(x, r"\(", 2))
    named = F.transform(F.filter(cut, lambda x: F.size(x) == 2), lambda x: F.struct(F.regexp_extract(x[0], "[A-Z]*$", 0).alias("0"), x[1].alias("1")))
    return F.filter(named, lambda x: (x["0"] != "") & (x["1"] != ""))


def service_response(fingerprint: Column) -> Column:
    """The first 200 characters after the ``SF`` marker and its separator; null without one."""
    between = F.get(F.split(fingerprint, "SF"), F.lit(1))
    return F.substring(F.when(F.substring(between, 1, 1).isin("-", ":"), F.substring(between, F.lit(2), F.length(between))).otherwise(between), 1, 200)
