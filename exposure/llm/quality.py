"""Quality scores by random Fourier features and calibrated ridge regression.

The figures of ``statistics`` are scaled to mean 0 and deviation 1 over all documents. Cosines of random projections of
them have inner products that approximate a Gaussian kernel, so a linear fit on them is a kernel fit at fixed cost. Each
task sums its part of the normal equations over its labelled rows; Spark adds the parts up, entry by entry, and the driver
solves one system of ``features`` + 1 unknowns whatever the number of rows. Isotonic regression over the counts of 0 and
1 in fixed bins of the raw score turns it into a probability.

All labelled rows outside the held-out fold are used. Neither lang, source, doc_id nor n_chars is an input. Null and empty
texts have the figures of a text without words and get that score. Without labels, or with one class alone, all scores are
that of the prior (0.5 without labels). Rows that repeat a doc_id are scored one by one; the labels of a doc_id count for
each of its rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm import statistics
from exposure.llm.sampling import held_out, training_labels
from exposure.llm.shared import stored

BINS = 400


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``x``, the figures of the text, and the columns ``carry``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics.figures(at.text_column(batch.column(1)))
            flat = pa.array(x.ravel())
            edges = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, flat), *batch.columns[2:]], ["doc_id", "x", *carry])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *carry).mapInArrow(at.lean(measure), "doc_id long, x array<double>" + _types(docs, carry))


def _types(docs: DataFrame, columns: tuple[str, ...]) -> str:
    return "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in columns)


def matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Fourier:
    """cos(x w + b) for scaled figures x; ``width`` is the kernel's."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float):
        rng = np.random.default_rng(9)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.deviation, -8, 8)
        z = np.cos(scaled @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def pooled(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Isotonic regression of ``good / total`` over bins: blocks of neighbours are pooled until their means ascend. Empty
    bins take the value of the block before them, or of the first."""
    blocks: list[list[float]] = []
    for g, t in zip(good, total):
        if t:
            blocks.append([g, t, 1])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                g2, t2, n2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    means = np.repeat([(g + 0.5) / (t + 1) for g, t, _ in blocks], [n for _, _, n in blocks])  # a step short of 0 and 1
    out = np.full(len(total), np.nan)
    out[total > 0] = means
    full = np.flatnonzero(total > 0)
    return np.interp(np.arange(len(total)), full, out[full])


def summed(rows: DataFrame, size: int, make) -> np.ndarray:
    """The sum over all rows of a vector of ``size`` that ``make(batch)`` gives for a batch: tasks add up their batches,
    Spark adds up the tasks' vectors entry by entry, and ``size`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "v"])

    out = np.zeros(size)
    for row in rows.mapInArrow(at.lean(add), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row["i"]] = row["v"]
    return out


def fit(x: DataFrame, labels: DataFrame, label: str, features: int, width: float, ridge: float):
    """(Fourier map, weights, bin values) from measured texts; weights are None without two classes."""
    n = len(statistics.NAMES)
    moments = summed(x, 2 * n + 1, lambda b: np.concatenate([(m := matrix(b.column("x"))).sum(0), (m**2).sum(0), [len(m)]]))
    count = max(moments[-1], 1)
    mean = moments[:n] / count
    fourier = Fourier(mean, np.sqrt(np.maximum(moments[n:-1] / count - mean**2, 0)), features, width)
    rows = stored(x.join(training_labels(labels, [label]).withColumnRenamed(label, "y"), "doc_id").select("x", "y"), "labelled")

    d = features + 1
    upper = np.triu_indices(d)

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = fourier(matrix(batch.column("x"))), np.asarray(batch.column("y"))
        return np.concatenate([(z.T @ z)[upper], z.T @ y, [y.sum(), len(y)]])

    sums = summed(rows, len(upper[0]) + d + 2, equations)
    positive, total = sums[-2:]
    if not 0 < positive < total:
        return fourier, None, np.array([positive / total if total else 0.5])
    gram = np.zeros((d, d))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    weights = np.linalg.solve(gram + ridge * np.eye(d), sums[len(upper[0]) : -2])

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        bin_ = bins(fourier(matrix(batch.column("x"))) @ weights)
        y = np.asarray(batch.column("y"))
        return np.concatenate([np.bincount(bin_, weights=y, minlength=BINS), np.bincount(bin_, minlength=BINS)])

    both = summed(rows, 2 * BINS, counts)
    return fourier, weights, pooled(both[:BINS], both[BINS:])


def bins(raw: np.ndarray) -> np.ndarray:
    """Bins of raw scores between -0.5 and 1.5."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", features: int = 256, width: float = 4.0, ridge: float = 1e-3, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5 on) and the columns ``carry``."""
    x = stored(measured(docs, id_col, text_col, carry), "figures")
    fourier, weights, values = fit(x, labels, label, features, width, ridge)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("x"))
            out = np.full(len(m), values[0]) if weights is None else values[bins(fourier(m) @ weights)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), *(batch.column(c) for c in carry)], ["doc_id", "score", *carry])

    scored = x.mapInArrow(at.lean(rate), "doc_id long, score double" + _types(docs, carry))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry)
