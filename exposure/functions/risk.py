"""Diminishing-returns scoring as a closed expression over counters.

A host's score adds its weights in descending order, the i-th one (from 0)
divided by log2(i + 2). With ``H[n]`` the sum of 1 / log2(k + 1) for k = 1..n and
``n(w)`` how many weights are at least ``w``, summing by layers gives

    score = sum over distinct weights w of (w - next smaller weight) * H[n(w)]

so how many items reach each weight is all that matters, and the weights come
from a small fixed set. That turns a per-host sort and window into one hash
aggregation with fixed-width counters, which pre-aggregates on the map side and so
is indifferent to a host holding most of the rows.

``H`` stops at ``RANKS``. That loses nothing: every layer is at least 1 thick and
``H[RANKS]`` exceeds the cap, so a host with more items than that scores 100
whatever the rest add.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from exposure import dims

MAX_SCORE = 100


def harmonic_table(beyond: float) -> list[float]:
    """Partial sums of 1 / log2(k + 1), up to the first one above ``beyond``."""
    table = [0.0]
    while table[-1] <= beyond:
        table.append(table[-1] + 1.0 / math.log2(len(table) + 1))
    return table


HARMONIC = harmonic_table(MAX_SCORE + 1)
RANKS = len(HARMONIC) - 1


def port_score_weights() -> list[int]:
    """Every weight an open port can carry, heaviest first."""
    base = {w for table in (dims.PORT_RISK, dims.SERVICE_RISK) for m in table.values() for w in m.values()}
    both = base | {w + dims.CLEARTEXT_BONUS for w in base | {0}}
    return sorted(both, reverse=True)


def finding_score_weights() -> list[int]:
    """Every weight a finding can carry, heaviest first."""
    base = set(dims.SEVERITY_RISK.values()) | {0}
    return sorted((base | {w + dims.EXPLOIT_BONUS for w in base}) - {0}, reverse=True)


def finding_weight(severity: Column, exploit: Column) -> Column:
    weight = F.lit(0)
    for sev, w in dims.SEVERITY_RISK.items():
        weight = F.when(severity == sev, w).otherwise(weight)
    return weight + F.when(exploit, dims.EXPLOIT_BONUS).otherwise(0)


def weight_counters(weight: str, weights: list[int], prefix: str) -> list[Column]:
    """For each possible weight, how many items reach it; ``weight`` names a column."""
    return [F.expr(f"count_if({weight} >= {w}) AS {prefix}{w}") for w in weights]


def harmonic_column() -> Column:
    """The table of partial sums as one foldable array."""
    text = ",".join(repr(v) for v in HARMONIC)
    return F.split(F.lit(text), ",").cast("array<double>")


def harmonic(count: str, table: str) -> str:
    """SQL for ``H[count]``, held at the last entry beyond the table."""
    return f"get({table}, CAST(least({count}, {RANKS}L) AS INT))"


def diminishing_sum(weights: list[int], prefix: str, table: str) -> Column:
    """Score from the counters of :func:`weight_counters`, rounded to 9 places.

    ``table`` names the column holding :func:`harmonic_column`. The rounding makes a
    later half-way decision independent of summation order.
    """
    layers = [
        f"{w - below}D * {harmonic(f'coalesce({prefix}{w}, 0L)', table)}"
        for w, below in zip(weights, weights[1:] + [0])
    ]
    return F.expr(f"round({' + '.join(layers)}, 9)")


def final_score(port_risk: Column, finding_risk: Column, profile: str = "web") -> Column:
    """0..100: the web profile rounds half up, the desktop profile truncates."""
    top = F.greatest(port_risk, finding_risk)
    whole = F.round(top, 0) if profile == "web" else F.floor(top)
    return F.least(whole.cast("int"), F.lit(MAX_SCORE))
