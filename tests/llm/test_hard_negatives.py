"""Hard negatives against a search through all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from exposure.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row int, q string, pos string, key string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "q", "p", "k", 0.5) for r in rows], SCHEMA)


def brute(rows, anchor, k=5, window=(80, 100)):
    """Sorted (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    place = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, (i, v, label) in enumerate(good):
        if i is None or not anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other == label) for b, (j, w, other) in enumerate(good) if b != a and len(w) == len(v)]
        for ps, pid, _ in sorted((x for x in scored if x[2]), key=place)[:k]:
            fit = sorted((x for x in scored if not x[2] and window[0] * ps <= 100 * x[0] <= window[1] * ps), key=place)[:k]
            out += [(i, pid, n, nid, ps, ns) for n, (ns, nid, _) in enumerate(fit, start=1)]
    return sorted(out, key=str)


def vectors(n, dim=6, seed=0, copies=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]
    return rows + [(n + j, list(rows[0][1]), j % 3) for j in range(copies)]


@pytest.mark.parametrize("rows", [vectors(400), vectors(150, copies=150), vectors(60, dim=1), []], ids=["clusters", "copies", "line", "empty"])
def test_equals_a_search_through_all_pairs(spark, rows):
    got = hn.mine(frame(spark, rows), anchor=lambda i: i % 10 == 0, block=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, lambda i: i % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_nulls_odd_numbers_and_repeated_rows(spark):
    rows = vectors(80)
    v = rows[3][1]
    rows += [(None, v, 1), (None, v, 2), (900, None, 1), (901, v, None), (902, [*v[:5], None], 1), (903, [*v[:5], float("nan")], 1), (904, [*v[:5], float("inf")], 0), (905, v[:3], 1), (910, v[:3], 2)]
    rows += [(906, [], 0), (920, [], 0), (930, [], 1), (907, [1e-30] * 6, 0)] + [rows[10]] * 4
    got = hn.mine(frame(spark, rows), anchor=lambda i: i % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, lambda i: i % 10 == 0)


def test_huge_components_keep_their_order(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 2.0], 0), (2, [9e29, 1.0], 1), (3, [-1e30, 0.0], 1)]
    got = [tuple(r) for r in hn.mine(frame(spark, rows), anchor=lambda i: i == 0).collect()]
    assert [r[:4] for r in got] == [(0, 1, 1, 2)] and 0 < got[0][5] <= got[0][4] < 2**63


def test_labels_may_be_derived(spark):
    rows = vectors(100)
    shifted = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows]
    got = hn.mine(frame(spark, rows), anchor=lambda i: i % 10 == 0, label=lambda i, l: F.when(i % 7 == 0, (l + 1) % 10).otherwise(l))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(shifted, lambda i: i % 10 == 0)


def tree_of(q):
    n = len(q)
    return hn.Tree(np.arange(n), np.arange(n), np.zeros(n, bool), np.arange(n) % 2, q)


def test_boxes_hold_their_rows_and_bounds_hold():
    rng = np.random.default_rng(0)
    q = rng.integers(-300, 300, (3000, 5))
    tree, v = tree_of(q), rng.integers(-300, 300, 5)
    for level, node in enumerate(tree.levels):
        for k in range(len(node.low)):
            a, b = node.begin[k], node.end[k]
            below = tree.q[a:b] if level == 0 else None
            low, high = (tree.levels[level - 1].low[a:b], tree.levels[level - 1].high[a:b]) if level else (below, below)
            assert (node.low[k] == low.min(axis=0)).all() and (node.high[k] == high.max(axis=0)).all()
            if level == 0:
                least, most = (x[0, k] for x in tree.bounds(v[None])[0])
                assert least <= (below @ v).min() and (below @ v).max() <= most
    assert sorted(tree.row.tolist()) == list(range(3000)) and len(tree.levels[-1].low) == 1


class Counted(np.ndarray):
    seen = 0

    def __getitem__(self, at):
        if isinstance(at, slice):
            Counted.seen += at.stop - at.start
        return super().__getitem__(at)


def test_clustered_rows_are_pruned():
    rng = np.random.default_rng(1)
    q = (rng.normal(0, 300, (40, 1, 4)) + rng.normal(0, 5, (40, 200, 4))).reshape(-1, 4).astype(np.int64)
    tree = tree_of(q)
    tree.q = tree.q.view(Counted)
    best = [hn.Best(5)]
    hn.search(tree, q[17], [(low[0], high[0]) for low, high in tree.bounds(q[17:18])], [hn.Search(0, 17, 1, True, None, None)], best)
    own = sorted(((-int(s), i) for i, s in enumerate(q @ q[17]) if i % 2 == 1 and i != 17))[:5]
    assert [r[:2] for r in best[0].rows] == own and Counted.seen < len(q) / 5


def test_tiles_part_by_dimension_and_size():
    batch = lambda dims: pa.RecordBatch.from_arrays([pa.array(dims, pa.int64())], ["dim"])
    got = [t["dim"].to_pylist() for t in hn.tiles(iter([batch([1] * 5), batch([1] * 2 + [2] * 3), batch([]), batch([2])]), size=4)]
    assert [x for t in got for x in t] == [1] * 7 + [2] * 4 and all(len(t) <= 4 and len(set(t)) == 1 for t in got)
