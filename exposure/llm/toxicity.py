"""Toxicity by a chain of classifiers.

Categories are label columns in a fixed order. A linear model for the first reads the text; each later one also reads the
probabilities of the categories before it. In training these are out of fold: every sampled row's come from models that
did not see it, so a later model learns how far an earlier one can be trusted.

A text is the set of its words and of their beginnings (5, 6 and 7 bytes), as 64-bit hashes. Spark counts in how many
labelled rows of each category every feature occurs, over all training rows, and takes the ``features`` with the largest
chi-square per category. Models are fit on at most ``sample`` labelled rows (those with the smallest hash of doc_id), which
come to the driver as one bit a feature; all documents are scored.

Rows of the held-out fold are never learned from. Words are runs of letters, lower-cased as far as Latin-1, any byte beyond ASCII
counting as a letter. Null and empty texts have no features and get the score of a text without any. A category without two
classes in the sample is given its share of ones. Labels with nulls are left out; repeated rows are scored one by one;
extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm.sampling import bounded, training_labels
from exposure.llm.shared import small, stored

PREFIXES = (5, 6, 7)
FOLDS = 3
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs; a pair may repeat."""
    buf = at.lower_ascii()[buf]
    after_c3 = np.flatnonzero(buf[:-1] == 0xC3) + 1  # capital letters of Latin-1, but for the multiplication sign
    after_c3 = after_c3[(buf[after_c3] >= 0x80) & (buf[after_c3] <= 0x9E) & (buf[after_c3] != 0x97)]
    buf[after_c3] += 0x20
    letter = _LETTER[buf]
    letter[: offsets[0]] = letter[offsets[-1] :] = False
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets] = True
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | begins[:-1]))
    ends = np.flatnonzero(letter & (~after | begins[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    owners, keys = [owner], [at.span_hashes(buf, starts, ends)]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts >= size)
        owners.append(owner[long])
        keys.append(at.mix64(at.span_hashes(buf, starts[long], starts[long] + size) + np.uint64(size)))
    return np.concatenate(owners), np.concatenate(keys)


def distinct(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    first = np.ones(len(key), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    return owner[first], key[first]


def feature_counts(labelled: DataFrame, names: list[str]) -> DataFrame:
    """feature, n (rows that have it) and for each category the rows with label 1 that have it. ``labelled``: text, labels."""
    schema = "feature long, n long, " + ", ".join(f"{c} double" for c in names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = at.text_column(batch.column("text"))
            y = np.stack([np.asarray(batch.column(c)) for c in names])
            for a, b in at.slices(texts):
                owner, key = distinct(*features(*at.buffer_of(texts.slice(a, b - a))))
                seen, where = np.unique(key, return_inverse=True)
                sums = [np.bincount(where, minlength=len(seen))] + [np.bincount(where, weights=y[k, a:b][owner], minlength=len(seen)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), *map(pa.array, sums)], ["feature", "n", *names])

    found = labelled.select("text", *names).mapInArrow(count, schema)
    return found.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", *names)))


def selected(counts: DataFrame, totals: dict[str, float], names: list[str], limit: int, least: int) -> np.ndarray:
    """Sorted hashes of the ``limit`` features of each category with the largest chi-square, among those in ``least`` rows."""
    out: set[int] = set()
    all_, n = F.lit(totals["n"]), F.col("n")
    for c in names:
        yes, a = F.lit(totals[c]), F.col(c)
        chi = F.pow(a * (all_ - yes - (n - a)) - (n - a) * (yes - a), F.lit(2)) / (n * (all_ - n))
        best = counts.where((n >= least) & (n < all_)).orderBy(chi.desc(), "feature").limit(limit)
        out |= {r["feature"] for r in best.select("feature").collect()}
    return np.sort(np.array(sorted(out), np.int64).astype(np.uint64))


def presence(texts: pa.Array, chosen: np.ndarray) -> Iterator[np.ndarray]:
    """0/1 rows of which chosen features the texts have, slice by slice."""
    for a, b in at.slices(texts, 1 << 20):
        out = np.zeros((b - a, len(chosen)), np.float32)
        if len(chosen):
            owner, key = features(*at.buffer_of(texts.slice(a, b - a)))
            place = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
            hit = chosen[place] == key
            out[owner[hit], place[hit]] = 1
        yield out


class Linear:
    """Logistic regression with a squared penalty, by accelerated gradient descent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 400):
        self.share = float(y.mean()) if len(y) else 0.0
        self.w = None
        if not 0 < self.share < 1:
            return
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        probe = np.ones(x.shape[1], np.float32)
        for _ in range(20):
            probe = x.T @ (x @ probe)
            probe /= np.linalg.norm(probe)
        step = 1 / (0.25 * np.linalg.norm(x @ probe) ** 2 / len(x) + penalty)
        w = look = np.zeros(x.shape[1], np.float32)
        look[-1] = np.log(self.share / (1 - self.share))
        for k in range(rounds):
            slope = x.T @ ((sigmoid(x @ look) - y).astype(np.float32)) / len(x)
            slope[:-1] += penalty * look[:-1]
            new = look - step * slope
            look = new + k / (k + 3) * (new - w)
            w = new
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), min(max(self.share, 1e-3), 1 - 1e-3))
        return sigmoid(x @ self.w[:-1] + self.w[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def beside(x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    """Features with the earlier categories' log-odds, scaled down, beside them."""
    if not earlier:
        return x
    p = np.clip(np.stack(earlier, axis=1), 1e-3, 1 - 1e-3)
    return np.concatenate([x, (np.log(p / (1 - p)) / 4).astype(np.float32)], axis=1)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 for probabilities ``p`` of rows that were not learned from, half way to the next lower
    probability; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(np.flatnonzero(np.diff(p[order])), len(y) - 1)  # rows of one probability are taken together
    best = last[np.argmax((2 * hits / (taken + y.sum()))[last])]
    below = p[order][min(best + 1, len(y) - 1)]
    return float((p[order][best] + below) / 2)


def train_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple[list[Linear], list[np.ndarray]]:
    """One model a category, and the out-of-fold probabilities; ``y`` has a column for each category, ``fold`` says which
    rows are predicted together."""
    models, earlier = [], []
    for k in range(y.shape[1]):
        rows = beside(x, earlier)
        out = np.zeros(len(x))
        for f in range(FOLDS):
            own = fold == f
            if own.any():
                out[own] = Linear(rows[~own], y[~own, k])(rows[own])
        models.append(Linear(rows, y[:, k]))
        earlier.append(out)
    return models, earlier


def score(docs: DataFrame, labels: DataFrame, categories: list[str], target: str, sample: int = 20_000, limit: int = 300, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, ``p_<category>`` for each category in order, and ``toxic`` (p of ``target`` is at
    least the threshold with the best F1 on the out-of-fold probabilities)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    train = stored(training_labels(labels, categories, id_col), "labels")
    counts = stored(feature_counts(texts.join(small(train), "doc_id"), categories), "features")
    totals = texts.select("doc_id").join(small(train), "doc_id").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in categories)).first().asDict()
    chosen = selected(counts, totals, categories, limit, least)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for part in presence(at.text_column(batch.column("text")), chosen) for r in np.packbits(part > 0, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), *(batch.column(c) for c in categories)], ["doc_id", "bits", *categories])

    chosen_rows = texts.join(small(stored(bounded(train, sample), "sample"), sample), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("one")  # of rows that share an id one is learned from
    picked = chosen_rows.groupBy("doc_id").agg(one, *(F.max(c).alias(c) for c in categories)).select("doc_id", "one.text", *categories)
    rows = picked.mapInArrow(design, "doc_id long, bits binary, " + ", ".join(f"{c} double" for c in categories)).orderBy("doc_id", "bits").toArrow()
    x = np.unpackbits(np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -(-len(chosen) // 8)), axis=1)[:, : len(chosen)].astype(np.float32)
    y = np.stack([np.asarray(rows.column(c).combine_chunks()) for c in categories], axis=1)
    fold = (at.mix64(np.asarray(rows.column("doc_id").combine_chunks()).astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    models, unseen = train_chain(x, y, fold)
    k = categories.index(target)
    threshold = best_threshold(unseen[k], y[:, k])
    names = [f"p_{c}" for c in categories]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in models]
            for part in presence(at.text_column(batch.column("text")), chosen):
                earlier: list[np.ndarray] = []
                for k, model in enumerate(models):
                    earlier.append(model(beside(part, earlier)))
                    out[k].append(earlier[-1].astype(np.float64))
            columns = [pa.array(np.concatenate(c) if c else np.zeros(0)) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    scored = texts.mapInArrow(rate, "doc_id long, " + ", ".join(f"{c} double" for c in names))
    return scored.withColumn("toxic", F.col(f"p_{target}") >= threshold)
