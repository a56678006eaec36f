"""Near-duplicate groups by MinHash with tensored banding.

Two collections of ``m`` short bands of ``h`` minhashes each are computed, and every pair of a band of the first and a band
of the second makes the key of one of m * m tables. 2 * m * h minhashes thus serve tables that would take m * m * 2 * h of
their own.

1. A document becomes the set of its distinct word shingles (64-bit hashes). Documents of equal sets are one node, so a group
   of exact copies, however large, costs one.
2. Nodes that meet in a table are tied to one of them: first within an Arrow batch, so that a frequent key leaves a task as
   one row, then over all batches. Ties join nodes to families; they are candidates, not links.
3. Within a family all pairs of full sets are compared, ``BLOCK`` nodes against ``BLOCK``, as a product of matrices of the
   shingles they share. No pair leaves a block but those that its links need to hang together.
4. Groups are the connected components of the links.

Any pair in a family is compared, also one that met in no table; a pair with similarity ``s`` that stands alone is missed
with a chance of about 2 * (1 - s ** h) ** m.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased. A text of fewer than ``k`` words but one at least has its
whole sequence as its only shingle; null, empty and blank texts have none and are linked with nothing. Rows that repeat a
doc_id are judged by their own texts. A null doc_id is never a group's id unless all its members are null. Extra columns
are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm.components import components
from exposure.llm.shared import stored

BLOCK = 256
#: Nodes of families, of about 60 bytes each, that may be sent to every executor.
BROADCAST_MEMBERS = 200_000


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    lower = at.lower_ascii()
    for a, b in at.slices(texts):
        buf, offsets = at.buffer_of(texts.slice(a, b - a))
        buf = lower[buf]
        starts, ends, edges = at.word_spans(buf, offsets)
        words = at.span_hashes(buf, starts, ends)
        for i in range(b - a):
            own = words[edges[i] : edges[i + 1]]
            width = min(k, len(own))
            if not width:
                yield own
                continue
            out = at.mix64(own[: len(own) - width + 1] + np.uint64(width))
            for j in range(1, width):
                out = at.mix64(out * np.uint64(0x9FB21C651E98DF25) + own[j : len(own) - width + 1 + j])
            yield np.unique(out)


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` fixed hash functions."""
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minhashes(shingles: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for s in range(0, len(shingles), 4096):
        x = shingles[s : s + 4096]
        out = np.minimum(out, ((x[None, :] * factors[:, None] + summands[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def sketches(docs: DataFrame, k: int, h: int, m: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, n_shingles, the set's 128-bit key (k1, k2), its minhashes, and the columns ``carry``."""
    factors, summands = permutations(2 * m * h)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, rows = [], [], []
            for s in shingle_sets(at.text_column(batch.column(1)), k):
                sizes.append(len(s))
                mixed = at.mix64(s ^ np.uint64(0x5BD1E9955BD1E995))
                keys.append((int(s.sum(dtype=np.uint64)), int(mixed.sum(dtype=np.uint64))))
                rows.append(minhashes(s, factors, summands).tobytes())
            k1, k2 = np.array(keys, np.uint64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), pa.array(rows, pa.binary()), *batch.columns[2:]], ["doc_id", "n_shingles", "k1", "k2", "sketch", *carry])

    carried = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *carry).mapInArrow(at.lean(sketch), "doc_id long, n_shingles long, k1 long, k2 long, sketch binary" + carried)


def table_keys(nodes: DataFrame, h: int, m: int) -> DataFrame:
    """(key, node, tie): for every table one row per key and batch, tied to itself, and the ties within the batch."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                node = np.asarray(part.column("node"), np.int64)
                bands = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint32).reshape(len(node), 2 * m, h).astype(np.uint64)
                half = np.zeros((len(node), 2 * m), np.uint64)
                for j in range(h):
                    half = at.mix64(half * np.uint64(0x9FB21C651E98DF25) + bands[:, :, j] + np.uint64(1))
                half = at.mix64(half + np.arange(2 * m, dtype=np.uint64))
                key = at.mix64(half[:, :m, None] + at.mix64(half[:, None, m:])).reshape(-1)
                owner = np.repeat(node, m * m)
                order = np.lexsort((owner, key))
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                leader = np.repeat(owner[first], np.diff(np.append(first, len(key))))
                rest = np.ones(len(key), bool)
                rest[first] = False
                ties = np.unique(np.stack([owner[rest], leader[rest]]), axis=1)
                own = at.mix64(at.mix64(ties[0].astype(np.uint64)) + ties[1].astype(np.uint64))
                columns = np.concatenate([key[first], own]), np.concatenate([owner[first], ties[0]]), np.concatenate([owner[first], ties[1]])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", "node", "tie"])

    return nodes.select("node", "sketch").mapInArrow(at.lean(keys), "key long, node long, tie long")


def families(nodes: DataFrame, h: int, m: int) -> DataFrame:
    """(node, root) for nodes that meet others in a table."""
    from pyspark.sql import Window

    met = table_keys(nodes, h, m).withColumn("least", F.min("node").over(Window.partitionBy("key")))  # a key has one row a batch
    ties = met.select(F.col("node").alias("a"), F.when(F.col("tie") != F.col("node"), F.col("tie")).otherwise(F.col("least")).alias("b"))
    return components(ties)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets have 100 * |both| >= percent * |either|, as a matrix."""
    sizes = np.array([len(s) for s in sets])
    value, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[place]
    owner, column = owner[keep], column[place[keep]]
    both, width = np.zeros((len(sets), len(sets)), np.float32), max(1, (1 << 22) // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], column[lo:hi] - c] = 1
        both += x @ x.T
    both = np.rint(both).astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def forest(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row it is connected with."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            reached = adjacent[i] | (np.arange(len(adjacent)) == i)
            grown = reached
            while grown.any():
                more = adjacent[grown].any(axis=0) & ~reached
                reached, grown = reached | more, more
            root[reached] = i
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, from batches sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now])
        key = [np.asarray(held.column(k)) for k in keys]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        edges = [0, *change.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield held.slice(a, b - a)
        held = held.slice(edges[-1])
    if held is not None:
        yield held


def links(docs: DataFrame, members: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that connect the nodes of each family as their exact links do. ``members``: node, family, rep (a doc_id
    of the node), k1, k2."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = np.asarray(batch.column("k1")).astype(np.uint64), np.asarray(batch.column("k2")).astype(np.uint64)
            kept, sets = [], []
            for i, s in enumerate(shingle_sets(at.text_column(batch.column("text")), k)):
                if s.sum(dtype=np.uint64) == k1[i] and at.mix64(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64) == k2[i]:
                    kept.append(i)
                    sets.append(s.tobytes())
            out = batch.take(pa.array(kept, pa.int64())).select(["node", "family", "blocks"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sets, pa.binary())], ["node", "family", "blocks", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["family", "x", "y"]):
            node = np.asarray(group.column("node"))
            root = forest(linked([np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()], percent))
            own = root == np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(node[~own]), pa.array(node[root[~own]])], ["a", "b"])

    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # Few members go to the tasks that read the texts; more of them, and all texts, meet in a shuffle.
    wanted = members.join(sizes, "family")
    wanted = F.broadcast(wanted) if members.limit(BROADCAST_MEMBERS + 1).count() <= BROADCAST_MEMBERS else wanted
    texts = docs.select(F.col(id_col).cast("long").alias("rep_id"), F.col(text_col).alias("text"))
    held = texts.join(wanted, texts["rep_id"].eqNullSafe(wanted["rep"])).select("node", "family", "blocks", "k1", "k2", "text")
    held = held.mapInArrow(at.lean(with_sets), "node long, family long, blocks int, shingles binary")
    # A block meets itself (where it is the only one) or every other block of its family.
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block"))))
    spread = held.withColumn("block", block).withColumn("other", other).select("family", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "shingles")
    return spread.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(at.lean(compare), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, h: int = 3, m: int = 13, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id of its group), the columns ``carry`` and kept
    (doc_id is component_id)."""
    rows = stored(sketches(docs, k, h, m, id_col, text_col, carry), "sketches")
    classes = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    roots = families(nodes, h, m).withColumnRenamed("root", "family")
    members = stored(nodes.select("node", "rep", "k1", "k2").join(roots, "node"), "members")
    groups = components(links(docs, members, k, percent, id_col, text_col))
    # A node without links is a group of its own.
    of = nodes.select("node", "rep", "k1", "k2").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = stored(of, "groups")
    ids = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = of.join(ids, "root").select("k1", "k2", "component_id")
    filled = rows.where("n_shingles > 0").drop("sketch").join(named, ["k1", "k2"])
    empty = rows.where("n_shingles = 0").select("k1", "k2", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *carry)
    out = filled.select("doc_id", "n_shingles", "component_id", *carry).union(empty.select("doc_id", "n_shingles", "component_id", *carry))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
