"""Packing documents into sequences by minimum bin slack.

A document is cut into full sequences and a remainder. Remainders are packed by their lengths alone: a count for each of
fewer than ``capacity`` lengths says all there is to know about them, whatever the number of documents, and is all that
reaches the driver. There a sequence takes the longest remainder left, and a subset-sum recurrence over a bitset of
reachable fills chooses the multiset of other lengths that leaves the least slack; going back through the bitsets gives
how many of each length it takes. The choice is repeated while the counts allow it, so the work follows the number of
lengths and not of documents.

Pieces are then numbered within their length (each task numbers its own, and sums over tasks give its first number), and a
piece finds its sequence by looking its number up in the plan.

A sequence is padded to ``capacity`` unless its fill is a power of two. Null and empty texts hold the end id alone. Repeated
doc_ids are documents of their own. Extra columns are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm.dac import with_end
from exposure.llm.shared import stored
from exposure.llm.tokens import id_table


class Pattern(NamedTuple):
    """``times`` sequences from number ``first``, each of ``count`` pieces of each ``length``."""

    first: int
    times: int
    lengths: list[tuple[int, int]]


def least_slack(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, count) multiset with the largest sum up to ``room``; ``order`` has the lengths in use, descending."""
    reach, target, steps = 1, 1 << room, []
    within = (target << 1) - 1
    for length in order:
        if length > room or not (left := counts[length]):
            continue
        steps.append((length, reach))
        left, step = min(left, room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & within
            left, step = left - take, step * 2
        if reach & target:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> (total - n * length) & 1:
            n += 1
        if n:
            chosen.append((length, n))
            total -= n * length
    return chosen


def plan(counts: dict[int, int], capacity: int, first: int = 0) -> list[Pattern]:
    """Patterns that use up ``counts``, a number of pieces for each length below ``capacity`` or equal to it."""
    counts = {k: v for k, v in counts.items() if v}
    order, out = sorted(counts, reverse=True), []
    while order:
        seed = order[0]
        counts[seed] -= 1
        chosen = dict(least_slack(counts, order, capacity - seed))
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        out.append(Pattern(first, times, sorted(chosen.items(), reverse=True)))
        first += times
        for k, n in chosen.items():
            counts[k] -= n * times
        order = [k for k in order if counts[k]]
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and its number among the task's pieces of its
    length (``part``, ``nth``); with ``ids`` (unsigned 32-bit, binary) if asked for."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, table, seen = TaskContext.get().partitionId(), id_table(vocabulary), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts, keys = at.text_column(batch.column(1)), batch.column(0)
            for a, b in at.slices(texts):
                ids, edges = with_end(*table.values(*at.buffer_of(texts.slice(a, b - a))), end_id)
                ids, sizes = ids.astype("<u4"), np.diff(edges)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                begin = edges[doc] + start
                raw = [ids[s : s + k].tobytes() for s, k in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                of = length[order]
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - np.searchsorted(of, of) + seen[of]
                np.add.at(seen, length, 1)
                columns = [keys.take(pa.array(doc + a)), start, length, [zlib.crc32(x) for x in raw], sizes[doc], np.full(len(doc), part, np.int64), nth] + [raw] * with_ids
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) if k == "ids" else pa.array(c, pa.int64()) for k, c in zip(names, columns)], names)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(at.lean(cut, tables=True), schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there."""
    cut = stored(pieces(docs, vocabulary, end_id, capacity, id_col, text_col, with_ids), "pieces")
    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    numbered = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows

    rows = []
    used = dict.fromkeys(counts, 0)
    for first, times, lengths in plan(counts, capacity):
        at_ = 0
        for length, n in lengths:
            rows.append((length, used[length], first, n, at_))
            used[length] += n * times
            at_ += n * length
    rows.sort()
    length, begin, first, per, base = (np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 5
    span = max([1, *counts.values()]) + 1
    key = length * span + begin

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("nth")) + np.asarray(batch.column("before"))
            row = np.searchsorted(key, size * span + rank, "right") - 1
            k = rank - begin[row]
            out = {n: batch.column(n) for n in batch.schema.names if n not in ("part", "nth", "before")}
            out |= {"sequence_id": pa.array(first[row] + k // per[row]), "offset": pa.array(base[row] + k % per[row] * size)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    joined = cut.join(numbered, ["part", "length"]).select(*cut.columns, "before")
    return joined.mapInArrow(at.lean(assign), schema)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences from ``pack(with_ids=True)``: sequence_id, n_ids, ids (unsigned 32-bit, binary, padded to
    ``capacity`` unless the fill is a power of two). A group holds at most ``capacity`` ids."""
    inner = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), inner.alias("parts"))
    raw = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    n = F.col("n_ids")
    padding = F.when(F.expr("bit_count(n_ids) = 1"), 0).otherwise(capacity - n)
    pad = F.unhex(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', {capacity})"))
    return filled.select("sequence_id", n, F.concat(raw, F.substring(pad, F.lit(1), (padding * 4).cast("int"))).alias("ids"))
