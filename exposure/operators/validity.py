"""Validity runs: from which scan to which scan a host, its state or an open port was seen without a gap.

Scans are numbered in time order (``place``, from 1). A run is a key with ``first_place`` and ``last_place``. The facts are
read once to make the runs; every difference of two scans is then a question to the runs, however many scans lie between:

* two scans that follow each other differ by the runs that begin or end there (:func:`step_log`, :func:`step_summary`),
  so the work grows with the changes and not with what stayed the same;
* any other pair asks which runs cover either scan (:func:`host_sides`, :func:`port_presence`, and the ``*_between`` forms).

Covering is an equi-join: a run is cut into its binary segments (at most two for each power of two up to its length),
a scan lies in one segment of each length, and the two meet in exactly one segment if the run covers the scan.

Scans without a start time have no place, as they have no predecessor; facts of such scans take no part. A null IP is a key
like any other in runs and sides, but no host is matched by it. Repeated facts count once. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from exposure.operators import diff
from exposure.sizes import is_small

#: Places that one 64-bit word holds.
WORD = 64
#: Words of a key that are gathered side by side in one row.
WORDS_IN_ROW = 8
STATE, PORT = ["ip", "os_name", "status"], ["ip", "port", "proto"]
TABLES = ("places", "states", "ports")


@dataclass(frozen=True)
class Validity:
    """``places`` (scan_id, place), ``states`` (ip, os_name, status, run) and ``ports`` (ip, port, proto, run)."""

    places: DataFrame
    states: DataFrame
    ports: DataFrame


def scan_places(runs: DataFrame) -> DataFrame:
    """Scans numbered by start time, then id, without sorting them in one task.

    A scan's place is the number of scans on earlier days plus its place within the day.
    """
    timed = runs.where("started_at IS NOT NULL").select("scan_id", "started_at", F.to_date("started_at").alias("day"))
    days = timed.groupBy("day").agg(F.count(F.lit(1)).alias("scans"))
    before = days.select("day", (F.sum("scans").over(Window.orderBy("day")) - F.col("scans")).alias("before"))
    in_day = F.row_number().over(Window.partitionBy("day").orderBy("started_at", "scan_id"))
    return timed.withColumn("in_day", in_day).join(before, "day").select("scan_id", (F.col("before") + F.col("in_day")).alias("place"))


def _joined(begins: Column, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that follow each other made one, ``begins`` saying where a new one starts."""
    order = Window.partitionBy(*keys).orderBy("first_place")
    numbered = rows.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order))
    return numbered.groupBy(*keys, "run").agg(F.min("first_place").alias("first_place"), F.max("last_place").alias("last_place")).drop("run")


def _after_gap(keys: list[str]) -> Column:
    before = F.lag("last_place").over(Window.partitionBy(*keys).orderBy("first_place"))
    return F.coalesce(before + 1 < F.col("first_place"), F.lit(True))


def presence_runs(facts: DataFrame, keys: list[str], last: int | None = None) -> DataFrame:
    """The longest runs of consecutive ``place`` values of each key.

    Places are gathered as bits of 64-bit words, a hash aggregation of fixed width with a map-side combine, so a key seen
    in every scan leaves a task as one row for 64 scans. Only the runs found in words are put in order. Where ``last``, the
    highest place, is known and few words reach it, all words of a key are one row, which is shuffled once for both steps.
    """
    bit, word = F.expr(f"shiftleft(1L, CAST(place % {WORD} AS INT))"), F.floor(F.col("place") / WORD)
    if last is not None and last // WORD < WORDS_IN_ROW:
        side_by_side = [F.bit_or(F.when(word == n, bit)).alias(f"bits{n}") for n in range(last // WORD + 1)]
        words = facts.groupBy(*keys).agg(*side_by_side).select(*keys, F.posexplode(F.array(*[f"bits{n}" for n in range(last // WORD + 1)])).alias("word", "bits"))
    else:
        words = facts.groupBy(*keys, word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    bits_of = lambda mask: F.expr(f"filter(sequence(0, {WORD - 1}), b -> (shiftrightunsigned({mask}, b) & 1L) = 1L)")
    ends = F.arrays_zip(
        bits_of("(bits & ~shiftleft(bits, 1))").alias("b"), bits_of("(bits & ~shiftrightunsigned(bits, 1))").alias("e")
    )
    place = lambda bit_no: F.col("word") * WORD + F.col(bit_no)
    found = words.where("bits IS NOT NULL").select(*keys, "word", F.inline(ends).alias("b", "e")).select(
        *keys, place("b").alias("first_place"), place("e").alias("last_place")
    )
    return _joined(_after_gap(keys), found, keys)


def build(runs: DataFrame, hosts: DataFrame, ports: DataFrame) -> Validity:
    """The runs of host states (best OS guess and status) and of open ports."""
    places = scan_places(runs)
    seen = hosts.groupBy("scan_id", "ip").agg(F.max("os_name").alias("os_name"), F.max("status").alias("status"))
    opened = ports.where(F.col("state") == "open").select("scan_id", *PORT)
    last = places.agg(F.max("place")).first()[0] or 0
    return Validity(
        places, presence_runs(seen.join(places, "scan_id").drop("scan_id"), STATE, last),
        presence_runs(opened.join(places, "scan_id").drop("scan_id"), PORT, last),
    )


def write(validity: Validity, path: str) -> None:
    for name in TABLES:
        getattr(validity, name).write.parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Validity:
    return Validity(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def host_runs(states: DataFrame) -> DataFrame:
    """Runs of a host's presence, whatever its state."""
    return _joined(_after_gap(["ip"]), states.select("ip", "first_place", "last_place"), ["ip"])


# ------------------------------------------------------------------ covering
def _segments(runs: DataFrame) -> DataFrame:
    """Each run once for each of its binary segments (``level``, ``node``)."""
    size = "last_place + 1 - first_place"
    low, high = "CAST(ceil(first_place / power) AS BIGINT)", "CAST(floor((last_place + 1) / power) AS BIGINT)"
    levels = runs.withColumn("level", F.expr(f"explode(sequence(0, CAST(floor(log2({size})) AS INT) + 1))"))
    edged = levels.withColumn("power", F.expr("shiftleft(1L, level)")).withColumn("low", F.expr(low)).withColumn("high", F.expr(high))
    nodes = F.expr("explode(filter(array(IF(low % 2 = 1, low, NULL), IF(high % 2 = 1, high - 1, NULL)), n -> n IS NOT NULL))")
    return edged.where("low < high").withColumn("node", nodes).drop("power", "low", "high")


def _levels(runs: DataFrame) -> Column:
    """The highest level a segment of these runs can have."""
    return F.coalesce(F.floor(F.log2(runs.agg(F.max(F.expr("last_place + 1 - first_place"))).scalar())).cast("int") + 1, F.lit(0))


def covering(runs: DataFrame, points: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Rows of ``runs`` and ``points`` where the run covers the point's ``place`` and ``on`` agrees.

    With ``on`` the join is spread by those columns too. Without, few points are broadcast; more of them meet the runs by
    segment and a salt of the IP, never by segment alone, which would gather all steady keys in one task. Both sides hold
    many more rows than the files they come from, by whose size Spark would broadcast them, so they are joined by sorting.
    """
    asked = points.withColumn("level", F.explode(F.sequence(F.lit(0), _levels(runs)))).withColumn("node", F.expr("shiftright(place, level)"))
    cut = _segments(runs).drop("first_place", "last_place")
    if on:
        return cut.join(asked.hint("merge"), [*on, "level", "node"]).drop("level", "node")
    if is_small(asked):
        return cut.join(F.broadcast(asked), ["level", "node"]).drop("level", "node")
    salted = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(diff.SALTS - 1))))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("ip"), F.lit(diff.SALTS)).cast("int"))
    return cut.join(salted.hint("merge"), ["level", "node", "salt"]).drop("level", "node", "salt")


def _points(validity: Validity, pairs: DataFrame) -> DataFrame:
    """Both places of each pair, tagged with ``side``."""
    side = lambda key, value: F.struct(F.col(key).alias("scan_id"), F.lit(value).alias("side"))
    sides = F.explode(F.array(side("base_id", diff.BASE), side("comp_id", diff.COMP)))
    return pairs.select(*diff.PAIR, sides.alias("s")).select(*diff.PAIR, "s.*").join(validity.places, "scan_id").drop("scan_id")


def host_sides(validity: Validity, pairs: DataFrame) -> DataFrame:
    """As :func:`diff.host_sides`, from the runs."""
    on = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return covering(validity.states, _points(validity, pairs)).groupBy(*diff.PAIR, "ip").agg(
        F.bit_or("side").alias("seen"),
        on(diff.BASE, "os_name").alias("base_os"), on(diff.COMP, "os_name").alias("comp_os"),
        on(diff.BASE, "status").alias("base_status"), on(diff.COMP, "status").alias("comp_status"),
    )


def port_presence(validity: Validity, pairs: DataFrame) -> DataFrame:
    """As :func:`diff.port_presence`, from the runs."""
    return covering(validity.ports, _points(validity, pairs)).groupBy(*diff.PAIR, *PORT).agg(F.bit_or("side").alias("seen"))


def moved_ports(validity: Validity, pairs: DataFrame) -> DataFrame:
    """The rows of :func:`port_presence` that are not in both scans, gathered by pair and IP.

    A run that covers both scans of a pair says that the port is in both and leaves before the shuffle. Where two runs do, they meet after it.
    """
    other = validity.places.select(F.col("scan_id").alias("other_id"), F.col("place").alias("other"))
    other_id = F.when(F.col("side") == diff.BASE, F.col("comp_id")).otherwise(F.col("base_id"))
    points = _points(validity, pairs).withColumn("other_id", other_id).join(other, "other_id", "left").drop("other_id")
    runs = validity.ports.withColumn("since", F.col("first_place")).withColumn("until", F.col("last_place"))
    alone = covering(runs, points).where(~F.coalesce(F.col("other").between(F.col("since"), F.col("until")), F.lit(False)))
    by_host = alone.select(*diff.PAIR, *PORT, "side").repartition(*diff.PAIR, "ip")
    return by_host.groupBy(*diff.PAIR, *PORT).agg(F.bit_or("side").alias("seen")).where(F.col("seen") != diff.BOTH)


def log_between(validity: Validity, pairs: DataFrame) -> DataFrame:
    """As :func:`diff.change_log`, for any pairs of scans."""
    return diff.log_of(host_sides(validity, pairs), moved_ports(validity, pairs))


def diff_between(validity: Validity, pairs: DataFrame) -> DataFrame:
    """As :func:`diff.host_diff`, for any pairs of scans."""
    return diff.diff_of(host_sides(validity, pairs), moved_ports(validity, pairs))


# ------------------------------------------------------------------ scans that follow each other
def _steps(validity: Validity) -> DataFrame:
    """``base_id``, ``comp_id`` and the place of the later scan."""
    later = validity.places.select(F.col("scan_id").alias("comp_id"), "place")
    return later.join(validity.places.select(F.col("scan_id").alias("base_id"), (F.col("place") + 1).alias("place")), "place")


def _borders(runs: DataFrame, last: Column) -> DataFrame:
    """Where runs begin (``kind`` :data:`diff.COMP`) and where they are gone (:data:`diff.BASE`), but for the first and beyond the last scan."""
    border = lambda place, kind: F.struct(place.cast("bigint").alias("place"), F.lit(kind).alias("kind"))
    both = F.array(border(F.col("first_place"), diff.COMP), border(F.col("last_place") + 1, diff.BASE))
    keys = [c for c in runs.columns if c not in ("first_place", "last_place")]
    return runs.select(*keys, F.explode(both).alias("at")).select(*keys, "at.*").where((F.col("place") > 1) & (F.col("place") <= last))


def _last(validity: Validity) -> Column:
    return validity.places.agg(F.max("place")).scalar()


def _stays(validity: Validity) -> DataFrame:
    """Runs of the later places at which a host was there before as well."""
    return host_runs(validity.states).withColumn("first_place", F.col("first_place") + 1).where("first_place <= last_place")


def _step_changes(validity: Validity) -> DataFrame:
    """Every change on hosts seen in both scans, by the place of the later scan."""
    none = F.lit(None).cast("string")
    moved = covering(_stays(validity), _borders(validity.ports, _last(validity)), ["ip"]).select(
        "place", "ip", F.when(F.col("kind") == diff.COMP, "port_added").otherwise("port_removed").alias("type"),
        F.concat(F.col("port").cast("string"), F.lit("/"), F.col("proto")).alias("port"), none.alias("from_value"), none.alias("to_value"),
    )
    order = Window.partitionBy("ip").orderBy("first_place")
    before = validity.states.where("ip IS NOT NULL").select(
        "*", *[F.lag(c).over(order).alias(f"{c}_before") for c in ("os_name", "status", "last_place")]
    ).where("last_place_before + 1 = first_place")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    change = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("from_value"), b.alias("to_value"))
    kinds = F.array(
        F.when(blank("os_name_before") != blank("os_name"), change("os_changed", blank("os_name_before"), blank("os_name"))),
        F.when(~F.col("status_before").eqNullSafe(F.col("status")), change("status_changed", F.col("status_before"), F.col("status"))),
    )
    turned = before.select(F.col("first_place").alias("place"), "ip", F.explode(F.array_compact(kinds)).alias("c"))
    return moved.unionByName(turned.select("place", "ip", "c.type", none.alias("port"), "c.from_value", "c.to_value"))


def step_log(validity: Validity) -> DataFrame:
    """The change log of all scans with the ones before them, from where runs begin and end."""
    changes = _step_changes(validity).join(_steps(validity), "place")
    return changes.select(*diff.PAIR, "ip", "type", "port", "from_value", "to_value")


def step_summary(validity: Validity) -> DataFrame:
    """As :func:`diff.diff_summary` of all scans with the ones before them, those without any host left out.

    Hosts that stayed are never listed: how many there are at a place is the sum of the runs counted in each of its segments.
    """
    stays = _stays(validity)
    counted = _segments(stays).groupBy("level", "node").agg(F.count(F.lit(1)).alias("hosts"))
    steps = _steps(validity)
    asked = steps.select("place", F.explode(F.sequence(F.lit(0), _levels(stays))).alias("level")).withColumn("node", F.expr("shiftright(place, level)"))
    stayed = asked.join(counted, ["level", "node"]).groupBy("place").agg(F.sum("hosts").alias("stayed"))
    came = _borders(host_runs(validity.states), _last(validity)).groupBy("place").agg(
        F.count_if(F.col("kind") == diff.COMP).alias("new_hosts"), F.count_if(F.col("kind") == diff.BASE).alias("removed_hosts")
    )
    changed = _step_changes(validity).groupBy("place", "ip").agg(F.lit(1).alias("one")).groupBy("place").agg(F.count(F.lit(1)).alias("changed_hosts"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    out = steps.join(stayed, "place", "left").join(came, "place", "left").join(changed, "place", "left")
    counts = [number(c).alias(c) for c in ("new_hosts", "removed_hosts", "changed_hosts")]
    out = out.select(*diff.PAIR, *counts, (number("stayed") - number("changed_hosts")).alias("unchanged_hosts"))
    return out.where("new_hosts + removed_hosts + changed_hosts + unchanged_hosts > 0")
