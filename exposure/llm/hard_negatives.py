"""Hard negatives: for an anchor and one of its nearest neighbours of the same label, the best-scoring rows of other labels whose
score lies in a window below that neighbour's.

**STR-packed R-trees.** Components become integers, floor(scale * x), and scores integer inner products. Rows are packed by
sort-tile-recursive: Spark's range partitions are the slabs of the first component, each is sorted by the second one and cut into
tiles, and a tile is sliced by the third and further components into leaves. Ranges are of (component, row number), so equal
vectors, however many, part like any others. Every leaf and every run of ``FANOUT`` nodes above has a minimum bounding box, which
with an anchor gives an interval for each coordinate's product, and by their sums one for the scores in the box.

**Search.** A task reads its tiles one after another and searches each with all anchors of a block, from the top: boxes are dropped whose
interval lies outside the score window, whose labels are of no use, or whose best score is strictly below the kth found so far
(with an equal score: whose smallest vec_id is above the kth's). The leaves left wait in a queue, the one that may hold the best score first. What is found in one tile prunes
the next. A task returns at most k rows for each anchor and window, which are merged by one sort.

Anchors are searched in blocks of at most ``block`` rows, which is what bounds the broadcast; each block reads the stored tiles
where they lie, without a shuffle of them.

Rows with a null label, a null vector or a null or non-finite component take no part. Ties of scores go by vec_id, null being the
largest, then by label and by place in the input, so rows alike in all are taken one by one. A row whose vec_id is null can be
found but is no anchor. Rows of different lengths don't meet; rows without components score 0. Integers are brought to a bound
at which no score leaves 64 bits (2**28 for 64 components, a million times what unit vectors reach). An empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm.ranks import numbered
from exposure.llm.shared import stored

FANOUT, LEAF, TILE = 16, 128, 8192
SOME = 1024  # anchors whose bounds are held at once
LONG = 2**63 - 1


def quantised(rows: DataFrame, scale: float, id_col: str, vector_col: str, label_col: str, label: Callable[[Column, Column], Column] | None) -> DataFrame:
    """row, vec_id, label, q and dim of the rows that take part."""
    number = lambda v: v.cast("double")
    sound = F.forall(vector_col, lambda v: F.coalesce(~F.isnan(number(v)) & (F.abs(number(v)) < float("inf")), F.lit(False)))
    usable = F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector_col), F.lit(1))))
    q = F.transform(vector_col, lambda v: F.floor(F.least(F.greatest(number(v) * scale, -most), most)).cast("long"))
    own, vec_id = F.col(label_col).cast("long"), F.col(id_col).cast("long")
    new = F.coalesce(label(vec_id, own), own) if label else own
    columns = vec_id.alias("vec_id"), new.cast("long").alias("label"), q.alias("q"), F.size(vector_col).cast("long").alias("dim")
    return rows.where(usable).select(F.monotonically_increasing_id().alias("row"), *columns)


def packed(rows: DataFrame) -> DataFrame:
    """The rows in slabs by the first component, each sorted by the second: a stored table. Equal vectors are parted by their row."""
    component = lambda k: F.get("q", F.lit(k))
    slabs = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(slabs, "dim", component(0), "row").sortWithinPartitions("dim", component(1), "row"), "slabs")


class Node(NamedTuple):
    """The boxes of one level: bounds of each, and what each holds."""

    low: np.ndarray
    high: np.ndarray
    least_label: np.ndarray
    most_label: np.ndarray
    least_id: np.ndarray
    begin: np.ndarray  # of its rows, or of its boxes one level below
    end: np.ndarray


def _sliced(q: np.ndarray, leaf: int, first: int) -> np.ndarray:
    """An order of rows in which runs of ``leaf`` are tiles: sorted and sliced by one component after another."""
    order = np.arange(len(q))
    stack = [(0, len(q), first)]
    while stack:
        a, b, k = stack.pop()
        leaves = -(-(b - a) // leaf)
        if leaves <= 1 or k >= q.shape[1]:
            continue
        order[a:b] = order[a:b][np.argsort(q[order[a:b], k], kind="stable")]
        slabs = leaves if k == q.shape[1] - 1 or k >= first + 2 else round(leaves ** (1 / (first + 3 - k)))
        size = -(-leaves // max(slabs, 1)) * leaf
        stack += [(s, min(s + size, b), k + 1) for s in range(a, b, size)] if size < b - a else [(a, b, k + 1)]
    return order


class Tree:
    """An R-tree of one tile, packed from below. ``place`` is a row's place by vec_id, label and row, for ties."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, null: np.ndarray, label: np.ndarray, q: np.ndarray):
        order = _sliced(q, LEAF, 2)
        self.row, self.vec_id, self.null, self.label, self.q = row[order], vec_id[order], null[order], label[order], q[order]
        self.place = np.empty(len(order), np.int64)
        self.place[np.lexsort((self.row, self.label, self.null, self.vec_id))] = np.arange(len(order))
        self.levels: list[Node] = []
        low, high, a, b, c = self.q, self.q, self.label, self.label, self.vec_id
        size = LEAF
        while not self.levels or len(low) > 1:
            starts = np.arange(0, len(low), size)
            ends = np.append(starts[1:], len(low))
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            a, b, c = np.minimum.reduceat(a, starts), np.maximum.reduceat(b, starts), np.minimum.reduceat(c, starts)
            self.levels.append(Node(low, high, a, b, c, starts, ends))
            size = FANOUT

    def bounds(self, vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the least and the greatest score that each vector can have in each box: the sums, over the coordinates, of
        the ends of the interval between its component times one bound of the box and times the other."""
        up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
        return [(up @ n.low.T + down @ n.high.T, up @ n.high.T + down @ n.low.T) for n in self.levels]


class Search(NamedTuple):
    """What is looked for with one anchor: rows of its label or of the others, with scores from ``low`` to ``high`` (none: any)."""

    key: int
    row: int
    label: int
    same: bool
    low: int | None
    high: int | None


class Best:
    """The first k rows of a search, best first: (-score, vec_id, (whether that is null, label, row))."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def last(self) -> tuple[int, int]:
        """Score and vec_id of the kth row; what comes after it is of no use."""
        return (-self.rows[-1][0], self.rows[-1][1]) if len(self.rows) == self.k else (-LONG - 1, LONG)

    def add(self, rows: Iterator[tuple]) -> None:
        self.rows = sorted([*self.rows, *rows])[: self.k]


def search(tree: Tree, vector: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], wanted: list[Search], best: list[Best]) -> None:
    """Adds what the tile has for the searches of one anchor, which are all for its own label or all for others. ``bounds`` are those of the
    anchor. The queue of leaves is taken from its head in growing runs; what is left is judged again after each."""
    same, label, own = wanted[0].same, wanted[0].label, wanted[0].row
    lows = np.array([-LONG if s.low is None else s.low for s in wanted])
    highs = np.array([LONG if s.high is None else s.high for s in wanted])

    def useful(level: int, boxes: np.ndarray) -> np.ndarray:
        """The boxes that may hold something for one of the searches."""
        node, (low, high) = tree.levels[level], (x[boxes, None] for x in bounds[level])
        kth = [b.last() for b in best]
        score, vec_id = np.array([k[0] for k in kth]), np.array([k[1] for k in kth])
        most = np.minimum(high, highs)
        may = (high >= lows) & (low <= highs) & ((most > score) | ((most == score) & (node.least_id[boxes, None] <= vec_id)))
        least_label, most_label = node.least_label[boxes], node.most_label[boxes]
        return boxes[may.any(axis=1) & ((least_label <= label) & (label <= most_label) if same else (least_label < label) | (label < most_label))]

    boxes = np.arange(len(tree.levels[-1].low))
    for level in range(len(tree.levels) - 1, 0, -1):
        boxes, node = useful(level, boxes), tree.levels[level]
        boxes = at.ragged_index(node.begin[boxes], node.end[boxes] - node.begin[boxes])
    boxes, width = useful(0, boxes), 2
    queue = boxes[np.argsort(-bounds[0][1][boxes], kind="stable")]
    while len(queue):
        leaves = tree.levels[0]
        now, queue, width = queue[:width], queue[width:], width * 2
        begin, end = leaves.begin[now], leaves.end[now]
        rows = at.ragged_index(begin, end - begin)
        score = np.concatenate([tree.q[a:b] @ vector for a, b in zip(begin.tolist(), end.tolist())])
        fit = (score >= min(max(s, b.last()[0]) for s, b in zip(lows.tolist(), best))) & (score <= highs.max())
        rows, score = rows[fit], score[fit]
        fit = (tree.label[rows] == label) & (tree.row[rows] != own) if same else tree.label[rows] != label
        rows, score = rows[fit], -score[fit].astype(np.int64)
        order = np.lexsort((tree.place[rows], score))
        rows, score = rows[order], score[order]
        for low, high, own_best in zip(lows.tolist(), highs.tolist(), best):
            a = int(np.searchsorted(score, -high))
            new = rows[a : a + own_best.k][score[a : a + own_best.k] <= -low]
            if len(new):
                own_best.add(zip(score[a:].tolist(), tree.vec_id[new].tolist(), zip(tree.null[new].tolist(), tree.label[new].tolist(), tree.row[new].tolist())))
        queue = useful(0, queue)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim) if dim else np.zeros((len(column), 0), np.int64)


def _tree(table: pa.Table, dim: int, largest: int) -> tuple[Tree, type]:
    """The tree of a tile, and the numbers to search it with: floating ones where they hold all sums of products exactly."""
    q = _vectors(table["q"].combine_chunks(), dim)
    most = max(dim, 1) * max(largest, 1) * max(int(np.abs(q).max(initial=0)), 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    ids = table["vec_id"].combine_chunks()
    own = lambda n: np.asarray(table[n].combine_chunks(), np.int64)
    return Tree(own("row"), np.asarray(ids.fill_null(LONG), np.int64), np.asarray(ids.is_null()), own("label"), q.astype(kind)), kind


def tiles(batches: Iterator[pa.RecordBatch], size: int = TILE) -> Iterator[pa.Table]:
    """The rows in runs of one dimension and of at most ``size`` rows."""
    held: list[pa.RecordBatch] = []

    def runs() -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held)
        dims = np.asarray(table["dim"])
        edges = np.concatenate([[0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield from (table.slice(s, min(size, b - s)) for s in range(a, b, size))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= size:
            *whole, rest = runs()
            yield from whole
            held = rest.to_batches()
    if sum(map(len, held)):
        yield from runs()


def found(slabs: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """key, score, vec_id, label, row: for each search at most k rows from each task. ``anchors`` (row, label, q, dim, searches: an
    array of key, low and high) has a bounded number of rows, which go to all tasks."""
    asked: dict[int, list] = {}
    for r in anchors.collect():
        asked.setdefault(r["dim"], []).append((np.array(r["q"], np.int64), [Search(s["key"], r["row"], r["label"], same, s["low"], s["high"]) for s in r["searches"]]))
    shared = slabs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = {s.key: Best(k) for own in asked.values() for _, searches in own for s in searches}
        largest = {dim: max(int(np.abs(v).max(initial=0)) for v, _ in own) for dim, own in asked.items()}
        for table in tiles(batches):
            dim = table["dim"][0].as_py()
            if dim in asked:
                tree, kind = _tree(table, dim, largest[dim])
                vectors = np.array([v for v, _ in asked[dim]]).reshape(len(asked[dim]), dim).astype(kind)
                for a in range(0, len(vectors), SOME):
                    bounds = tree.bounds(vectors[a : a + SOME])
                    for n, (_, searches) in enumerate(asked[dim][a : a + SOME]):
                        search(tree, vectors[a + n], [(low[n], high[n]) for low, high in bounds], searches, [best[s.key] for s in searches])
        rows = [(key, -score, None if null else vec_id, label, row) for key, own in best.items() for score, vec_id, (null, label, row) in own.rows]
        columns = zip(*rows) if rows else [[]] * len(FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], FOUND)

    return slabs.select("row", "vec_id", "label", "q", "dim").mapInArrow(run, ", ".join(f"{n} long" for n in FOUND))


FOUND = ["key", "score", "vec_id", "label", "row"]


def _first(parts: list[DataFrame], k: int) -> DataFrame:
    """The first k of each search among what the tasks found, with their rank."""
    parts = functools.reduce(DataFrame.union, parts)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "label", "row")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Callable[[Column], Column], scale: float = 256.0, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), block: int = 8192,
    label: Callable[[Column, Column], Column] | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For each row whose vec_id makes ``anchor`` true, and each of its first ``positives`` rows of the same label, the first ``negatives``
    rows of other labels with ``window[0] * positive_score <= 100 * score <= window[1] * positive_score``: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. ``label`` may make the label from vec_id and label."""
    taken = stored(quantised(rows, scale, id_col, vector_col, label_col, label), "vectors")
    slabs = packed(taken)
    chosen = stored(taken.where(F.coalesce(anchor(F.col("vec_id")), F.lit(False))).withColumn("one", F.lit(0).cast("long")), "anchors")
    chosen = stored(numbered(chosen, "one", ["row"], "anchor-order"), "anchors")
    blocks = [chosen.where(F.col("pos").between(a, a + block - 1)) for a in range(0, max(chosen.count(), 1), block)]

    no = F.lit(None).cast("long")
    every = F.array(F.struct(F.col("pos").alias("key"), no.alias("low"), no.alias("high")))
    near = [stored(found(slabs, b.withColumn("searches", every), True, positives), "positives") for b in blocks]
    near = _first(near, positives).select(F.col("key").alias("pos"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"), (F.col("key") * positives + F.col("rank") - 1).alias("key"))
    near = stored(near, "positives")

    low, high = F.expr(f"cast(ceil(cast({window[0]} as decimal(4,0)) * positive_score / 100) as long)"), F.expr(f"cast(floor(cast({window[1]} as decimal(4,0)) * positive_score / 100) as long)")
    windows = near.groupBy("pos").agg(F.collect_list(F.struct("key", low.alias("low"), high.alias("high"))).alias("searches"))  # at most `positives` each
    far = [stored(found(slabs, b.join(windows, "pos"), False, negatives), "negatives") for b in blocks]
    ids = chosen.select("pos", F.col("vec_id").alias("anchor_id"))
    hard = _first(far, negatives).select("key", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(ids, "pos").join(hard, "key").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
