"""Search through stored postings instead of the scan tables.

``build`` writes, below one folder, what a search needs:

``blocks``  kind, key, block, n, first, last, hosts: the hosts that carry a key, in sorted blocks. A host's block is a hash of it, the same for
            every key, so postings of two keys meet block by block. Their number grows with the hosts, so that a block has about
            ``per_block`` hosts however popular its key. Files are sorted by key and block within each kind.
``terms``   kind, key, to_kind, to_key, hosts: every distinct text that a field can hold, and whose postings it stands for. A CVE of the
            database stands for the products it is listed under, an administrative port's name for the port.
``grams``   the terms again, once for each three letters in a row of the key; ``gram_counts`` says how many terms have each.
``texts``   block, scan_id, ip, search_text: what a text search verifies.

A search resolves each term to keys by the rarest three letters of its longest fixed part and a test of the whole value, then intersects
postings from the term with the fewest hosts, reading of the others only the blocks that are still reached. Only the keys themselves,
at most ``LISTED`` a term, come to the driver, to become filters of the scan; a term with more keys joins them. Results equal those of
``operators.search``. Null values have no postings; empty ones have. An empty inventory has an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from exposure import dims
from exposure.functions import columns as C
from exposure.inventory import Inventory
from exposure.operators import filters
from exposure.operators import search as scan
from exposure.operators.tags import with_tags
from exposure.operators.vulns import cve_classes, open_products

KEY = C.HOST_KEY
#: Keys of a term that become literal filters.
LISTED = 200
#: Hosts that a row has at most while blocks are dealt to tasks.
PIECE = 8
TABLES = ("blocks", "terms", "grams", "gram_counts", "texts")

FIELD_KINDS = {
    "port": "port", "service": "service", "svc": "service", "product": "product", "os": "os", "ip": "ip", "host": "hostname",
    "hostname": "hostname", "mac": "mac", "tag": "label", "label": "label", "owner": "owner", "cve": "cve", "admin": "admin",
}
QUICK_KINDS = ("ip", "hostname", "os", "port", "service", "shut_port", "shut_service")


@dataclass(frozen=True)
class SearchIndex:
    blocks: DataFrame
    terms: DataFrame
    grams: DataFrame
    gram_counts: DataFrame
    texts: DataFrame


@dataclass(frozen=True)
class Keys:
    """What a term resolves to: ``rows`` (kind, key), the same as a list if there are few, and how many postings they have."""

    rows: DataFrame
    listed: list[tuple[str, str]] | None
    hosts: float


# ------------------------------------------------------------------ building
def entries(inv: Inventory, texts: DataFrame) -> DataFrame:
    """(kind, key, scan_id, ip), repeats included: what each host can be found by."""
    keyed = lambda df, *pairs: df.select(
        *KEY, F.explode(F.array(*[F.struct(kind.alias("kind"), F.lower(key.cast("string")).alias("key")) for kind, key in pairs])).alias("k")
    ).select("k.kind", "k.key", *KEY)
    kind_of = lambda name: F.when(F.col("state") == "open", name).otherwise(f"shut_{name}")
    named = [(F.lit(kind), F.col(col)) for kind, col in (("ip", "ip"), ("hostname", "hostname"), ("mac", "mac"), ("os", "os_name"))]
    words = texts.select(F.lit("word").alias("kind"), F.explode(F.array_distinct(F.split("search_text", " "))).alias("key"), *KEY)
    parts = [
        keyed(inv.hosts, *named), words, open_products(inv.ports).select(F.lit("cpe").alias("kind"), F.col("stem").alias("key"), *KEY),
        keyed(inv.ports, (kind_of("port"), F.col("port")), (kind_of("service"), F.col("svc")), (F.lit("product"), F.col("product"))),
    ]
    if inv.tags is not None:
        tagged = with_tags(inv.hosts, inv.tags)
        parts += [keyed(tagged, (F.lit("owner"), F.col("owner"))), keyed(tagged.withColumn("label", F.explode("labels")), (F.lit("label"), F.col("label")))]
    if inv.findings is not None:
        parts.append(keyed(inv.findings.select(*KEY, F.explode("cves").alias("cve")), (F.lit("cve"), F.col("cve"))))
    return reduce(DataFrame.unionByName, parts).where(F.col("key").isNotNull())


def in_key_order(lists: DataFrame) -> DataFrame:
    """(kind, key, block, hosts) in ranges of about the same size.

    Spark draws ranges by rows, and a list has one host or thousands: those of popular keys lie side by side and would come to one
    task. So lists travel in pieces of at most ``PIECE`` hosts, which are put together where they arrive.
    """
    keys = ["kind", "key", "block"]
    pieces = F.expr(f"explode(transform(sequence(0, (size(hosts) - 1) DIV {PIECE}), i -> struct(i AS i, slice(hosts, int(i) * {PIECE} + 1, {PIECE}) AS part)))")
    dealt = lists.select(*keys, pieces.alias("p")).select(*keys, "p.*").repartitionByRange(*keys)
    whole = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("parts"))
    return whole.select(*keys, F.flatten("parts.part").alias("hosts"))


def to_blocks(rows: DataFrame) -> DataFrame:
    """Postings in blocks from (kind, key, block, scan_id, ip), in ranges of them. A list has the hosts of one block, not of a key."""
    lists = in_key_order(rows.groupBy("kind", "key", "block").agg(F.array_sort(F.collect_set(F.struct(*KEY))).alias("hosts")))
    return lists.select("kind", "key", "block", F.size("hosts").cast("bigint").alias("n"), F.get("hosts", F.lit(0)).alias("first"), F.element_at("hosts", -1).alias("last"), "hosts")


def to_terms(blocks: DataFrame, vuln_db: DataFrame | None) -> DataFrame:
    """The dictionary of the keys in ``blocks``, with the names that stand for other keys."""
    sizes = blocks.groupBy("kind", "key").agg(F.sum("n").alias("hosts"))
    standing = lambda kind, key, to: F.struct(F.lit(kind).alias("kind"), F.lower(key).alias("key"), to.alias("to_key"))
    of = lambda kind: sizes.where(F.col("kind") == kind).select(F.col("kind").alias("to_kind"), F.col("key").alias("to_key"), "hosts")
    dim = dims.admin_dim(blocks.sparkSession)
    port = F.col("port").cast("string")
    names = F.explode(F.array(standing("admin", F.col("admin_name"), port), standing("admin", F.col("admin_category"), port))).alias("s")
    found = [dim.select(names).select("s.*").distinct().join(of("port"), "to_key")]
    if vuln_db is not None:
        listed = cve_classes(vuln_db).select(F.explode("cves").alias("cve"), "products").select(F.lit("cve").alias("kind"), F.lower("cve").alias("key"), F.explode("products").alias("to_key"))
        found.append(listed.distinct().join(of("cpe"), "to_key"))
    own = sizes.select("kind", "key", F.col("kind").alias("to_kind"), F.col("key").alias("to_key"), "hosts")
    return reduce(DataFrame.unionByName, found, own)


def to_grams(terms: DataFrame) -> DataFrame:
    starts = F.sequence(F.lit(1), F.length("key") - 2)
    three = F.array_distinct(F.transform(starts, lambda i: F.substring("key", i, F.lit(3))))
    return terms.where(F.length("key") >= 3).select(F.explode(three).alias("gram"), "*")


def build(inv: Inventory, path: str, per_block: int = 4096) -> SearchIndex:
    """Writes the index of ``inv`` below ``path``, which all executors must reach.

    Hosts and ports are read several times and may be long plans, so they are written there first.
    """
    spark = inv.hosts.sparkSession

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{path}/read/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/read/{name}")

    inv = inv.with_tables(hosts=kept("hosts", inv.hosts), ports=kept("ports", inv.ports))
    blocks = max(1, -(-inv.hosts.count() // per_block))
    placed = lambda df: df.withColumn("block", F.pmod(F.xxhash64(*KEY), F.lit(blocks)).cast("int"))

    def write(name: str, df: DataFrame, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
        dealt = df if name == "blocks" else df.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.partitionBy(*by).parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    texts = write("texts", placed(scan.search_text(inv.hosts, inv)).select("block", *KEY, "search_text"), "block", *KEY)
    stored = write("blocks", to_blocks(placed(entries(inv, texts))), "kind", "key", "block", by=("kind",))
    terms = write("terms", to_terms(stored, inv.vuln_db), "kind", "key", "to_kind", "to_key")
    grams = write("grams", to_grams(terms), "kind", "gram", "key", "to_key")
    write("gram_counts", grams.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("terms")), "kind", "gram")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> SearchIndex:
    """The index below ``path``. Blocks are read by schema, as an index of nothing has no folder of a kind to infer it from."""
    plain = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES if name != "blocks"}
    host = plain["texts"].select(F.struct(*KEY).alias("h")).schema["h"].dataType.simpleString()
    schema = f"key string, block int, n bigint, first {host}, last {host}, hosts array<{host}>, kind string"
    return SearchIndex(blocks=spark.read.schema(schema).parquet(f"{path}/blocks"), **plain)


# ------------------------------------------------------------------ resolving terms
def longest_part(value: str) -> str:
    """The longest run without a wildcard."""
    return max(value.lower().split("*"), key=len)


def rarest_gram(index: SearchIndex, kinds: tuple[str, ...], part: str) -> str | None:
    """The three letters of ``part`` that the fewest terms have; None if some are in no term."""
    grams = {part[i : i + 3] for i in range(len(part) - 2)}
    counted = index.gram_counts.where(F.col("kind").isin(*kinds) & F.col("gram").isin(*grams)).groupBy("gram").agg(F.sum("terms").alias("terms"))
    met = counted.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("terms", "gram")).getField("gram").alias("gram")).first()
    return met.gram if met.n == len(grams) else None


def candidates(index: SearchIndex, kinds: tuple[str, ...], part: str) -> DataFrame:
    """Terms that may contain ``part``: those with its rarest three letters, or all if it is shorter."""
    of_kinds = F.col("kind").isin(*kinds)
    if len(part) < 3:
        return index.terms.where(of_kinds)
    gram = rarest_gram(index, kinds, part)
    if gram is None:
        return index.terms.where("false")
    return index.grams.where(of_kinds & (F.col("gram") == gram)).drop("gram")


def _keys(terms: DataFrame) -> Keys:
    rows = terms.select(F.col("to_kind").alias("kind"), F.col("to_key").alias("key"), "hosts").distinct()
    some = rows.limit(LISTED + 1).agg(F.collect_list(F.struct("kind", "key", "hosts")).alias("some")).first().some
    if len(some) > LISTED:
        return Keys(rows.drop("hosts"), None, float("inf"))
    return Keys(rows.drop("hosts"), sorted((r.kind, r.key) for r in some), sum(r.hosts for r in some))


def lookup(index: SearchIndex, kinds: tuple[str, ...], value: str) -> Keys:
    """The keys that ``value`` matches, by the rules of ``search.matches``."""
    return _keys(candidates(index, kinds, longest_part(value)).where(scan.matches(F.col("key"), value)))


def resolve(index: SearchIndex, field: str, value: str) -> Keys:
    """The keys of one search term; text terms resolve to words that any match must contain."""
    kind = FIELD_KINDS.get(field)
    if kind is None:
        return lookup(index, ("word",), max(longest_part(value).split(" "), key=len))
    bounds = scan.PORT_RANGE.match(value)
    if kind == "port" and bounds:
        number = F.col("key").try_cast("int")
        return _keys(index.terms.where((F.col("kind") == "port") & number.between(int(bounds[1]), int(bounds[2]))))
    if kind == "admin" and value.lower() in ("true", "yes", "*"):
        return _keys(index.terms.where(F.col("kind") == "admin"))
    return lookup(index, (kind,), value)


# ------------------------------------------------------------------ reading postings
def _any_of(listed: list[tuple[str, str]]) -> Column:
    kinds = sorted({kind for kind, _ in listed})
    tests = [(F.col("kind") == kind) & F.col("key").isin([key for k, key in listed if k == kind]) for kind in kinds]
    return reduce(Column.__or__, tests, F.lit(False))


def blocks_of(index: SearchIndex, keys: Keys) -> DataFrame:
    """The blocks of the keys: filters of the scan where they are few, a join otherwise."""
    if keys.listed is not None:
        return index.blocks.where(_any_of(keys.listed))
    return index.blocks.join(keys.rows, ["kind", "key"], "left_semi")


def _hosts_in(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.explode("hosts").alias("h")).select("block", "h.*")


def intersect(index: SearchIndex, found: list[Keys]) -> DataFrame:
    """(block, scan_id, ip) of hosts with a key of every term, from the term with the fewest postings."""
    first, *rest = sorted(found, key=lambda keys: keys.hosts)
    hosts = _hosts_in(blocks_of(index, first)).distinct()
    for keys in rest:
        reached = blocks_of(index, keys).join(hosts.select("block").distinct(), "block", "left_semi")
        hosts = hosts.join(_hosts_in(reached), ["block", *KEY], "left_semi")
    return hosts


def _split(terms: list[tuple[str, str]]) -> Iterator[list]:
    known = [(field.lower(), value) for field, value in terms]
    yield [value for field, value in known if field == "risk"]
    yield [(field, value) for field, value in known if field != "risk"]
    yield [value for field, value in known if field != "risk" and field not in FIELD_KINDS]


def search(inv: Inventory, index: SearchIndex, terms: list[tuple[str, str]]) -> DataFrame:
    """Hosts of ``inv`` meeting every term, as ``operators.search.search`` finds them; ``index`` was built from the same tables, or from
    more hosts. Texts are verified on what the postings leave, risk terms on one score of that."""
    risks, others, texts = _split(terms)
    # A text term of wildcards alone names no word and is left to the verification.
    found = [resolve(index, field, value) for field, value in others if field in FIELD_KINDS or longest_part(value).strip(" ")]
    if not others:
        hosts = inv.hosts
    else:
        met = intersect(index, found) if found else index.texts.select("block", *KEY)
        if texts:
            met = index.texts.join(met, ["block", *KEY], "left_semi").where(reduce(Column.__and__, [scan.matches(F.col("search_text"), v) for v in texts]))
        hosts = filters.hosts_with(inv.hosts, met)
    return scan.by_risk(hosts, inv, *risks) if risks else hosts


def search_and_filter(inv: Inventory, index: SearchIndex, terms: list[tuple[str, str]], filter_name: str = "all") -> DataFrame:
    """Up hosts meeting every term and the named entity filter."""
    return search(inv.with_tables(hosts=filters.entity_filter(inv, filter_name)), index, terms)


def quick_search(inv: Inventory, index: SearchIndex, value: str) -> DataFrame:
    """Hosts whose IP, host name, OS, or any port number or service contains ``value``."""
    return filters.hosts_with(inv.hosts, _hosts_in(blocks_of(index, lookup(index, QUICK_KINDS, value))))
