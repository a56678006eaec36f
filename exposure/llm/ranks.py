"""Places of rows in an order, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.llm.shared import small, stored


def numbered(rows: DataFrame, tree: str, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place of a row among those of its ``tree`` (a long, not null) in ``order``, from 0, and ``n``,
    how many rows the tree has.

    Rows are dealt by ranges of (tree, order), so a tree with most of the rows is spread over many tasks as long as ``order``
    tells its rows apart. Each task numbers its own rows; the sums over the tasks before it (a row for each task and tree)
    are added. ``rows`` should be a stored table, as its ranges are sampled first."""
    columns = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column(columns.index(tree)))
            starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            runs = np.diff(np.append(starts, len(own)))
            nth = np.arange(len(own)) - np.repeat(starts, runs)
            if own[0] == last:
                nth[: runs[0]] += done
            last, done = own[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int64)), pa.array(nth)], [*columns, "part", "nth"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part long, nth long"
    dealt = stored(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).mapInArrow(number, schema), name)
    counts = stored(dealt.groupBy(tree, "part").agg(F.count("*").alias("own")), f"{name}-counts")
    every = Window.partitionBy(tree)
    before = counts.select(tree, "part", (F.sum("own").over(every.orderBy("part")) - F.col("own")).alias("before"), F.sum("own").over(every).alias("n"))
    joined = dealt.join(small(stored(before, f"{name}-before")), [tree, "part"])
    return joined.select(*columns, (F.col("before") + F.col("nth")).alias("pos"), "n")
