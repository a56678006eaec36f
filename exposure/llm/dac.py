"""Token ids in directly addressable codes.

An id is cut into chunks of bits, lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap says
which of them go on in level k + 1. The number of set bits before a position, from a rank directory, is the position in
the next level, so any id is read from a few places without decoding those before it.

The file format is a Parquet table of blocks, written and committed by Spark to any store it knows. A block holds whole
documents in ascending order:

    shard int, block int     place of the block in the order of all documents
    n_tokens long            ids in the block
    doc_ids, doc_ends        each document's id, and the ids up to its end, as 64-bit integers; a null id is flagged in
    doc_nulls                one byte each
    widths array<int>        bits of each level
    levels array<binary>     the chunks, one byte or two each
    bitmaps array<binary>    continuation bits, 64 to a word, for all levels but the last
    supers, ranks            set bits before each 512 bits (32-bit), and before each word within them (16-bit)

Empty and null texts give a document of the end id alone. Rows that repeat a doc_id are kept as documents of their own,
in the order of a hash of their texts, and spread over shards by it. An empty table gives a table without blocks. Columns beside ``id_col`` and ``text_col`` are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm.shared import small, stored
from exposure.llm.tokens import id_table

WIDTHS = (8, 8, 16)
SCHEMA = (
    "shard int, block int, n_tokens long, doc_ids binary, doc_ends binary, doc_nulls binary, widths array<int>, "
    "levels array<binary>, bitmaps array<binary>, supers array<binary>, ranks array<binary>"
)


def rank_directory(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 64-bit words in groups of eight: set bits before each group, and before each word in its group."""
    counts = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
    within = np.cumsum(counts, axis=1) - counts
    groups = counts.sum(axis=1)
    return (np.cumsum(groups) - groups).astype(np.uint32), within.astype(np.uint16).ravel()


class Codes:
    """A sequence of ids in directly addressable codes."""

    def __init__(self, widths, levels, bitmaps, supers, ranks):
        self.widths, self.levels, self.bitmaps, self.supers, self.ranks = widths, levels, bitmaps, supers, ranks

    @classmethod
    def of(cls, ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> Codes:
        """Codes of ``ids``; levels after the last chunk in use are left out."""
        rest, used, levels, bitmaps, supers, ranks = ids.astype(np.uint64), [], [], [], [], []
        for k, width in enumerate(widths):
            used.append(width)
            levels.append((rest & np.uint64((1 << width) - 1)).astype(np.uint8 if width <= 8 else np.uint16))
            rest >>= np.uint64(width)
            more = rest > 0
            if not more.any():
                break
            if k == len(widths) - 1:
                raise ValueError(f"an id needs more than {sum(widths)} bits")
            bits = np.zeros(-(-len(more) // 512) * 64, np.uint8)
            packed = np.packbits(more, bitorder="little")
            bits[: len(packed)] = packed
            words = bits.view("<u8")
            a, b = rank_directory(words)
            bitmaps.append(words), supers.append(a), ranks.append(b)
            rest = rest[more]
        return cls(used, levels, bitmaps, supers, ranks)

    def get(self, positions: np.ndarray) -> np.ndarray:
        """The ids at ``positions``, in any order."""
        out = np.zeros(len(positions), np.uint32)
        where, at_, shift = np.arange(len(positions)), np.asarray(positions, np.int64), 0
        for k, level in enumerate(self.levels):
            out[where] |= level[at_].astype(np.uint32) << np.uint32(shift)
            shift += self.widths[k]
            if k == len(self.bitmaps):
                break
            word, bit = at_ >> 6, (at_ & 63).astype(np.uint64)
            here = self.bitmaps[k][word]
            more = (here >> bit) & np.uint64(1) > 0
            where, at_, word, bit, here = where[more], at_[more], word[more], bit[more], here[more]
            before = np.bitwise_count(here & ((np.uint64(1) << bit) - np.uint64(1)))
            at_ = self.supers[k][at_ >> 9].astype(np.int64) + self.ranks[k][word] + before
        return out

    def row(self) -> dict:
        parts = {"levels": self.levels, "bitmaps": self.bitmaps, "supers": self.supers, "ranks": self.ranks}
        return {"widths": self.widths} | {k: [x.tobytes() for x in v] for k, v in parts.items()}

    @classmethod
    def from_row(cls, row: dict) -> Codes:
        widths = row["widths"]
        read = lambda name, kind: [np.frombuffer(x, kind) for x in row[name]]
        levels = [np.frombuffer(x, np.uint8 if w <= 8 else "<u2") for x, w in zip(row["levels"], widths)]
        return cls(widths, levels, read("bitmaps", "<u8"), read("supers", "<u4"), read("ranks", "<u2"))


ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("doc_ends", pa.binary()), ("doc_nulls", pa.binary()), ("widths", pa.list_(pa.int32()))]
    + [(k, pa.list_(pa.binary())) for k in ("levels", "bitmaps", "supers", "ranks")]
)


def with_end(ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with ``end_id`` after each document, and the new offsets."""
    return np.insert(ids, edges[1:], end_id), edges + np.arange(len(edges))


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", widths: tuple[int, ...] = WIDTHS) -> None:
    """Encodes whole texts and writes their codes to ``path``, documents in ascending order of ``id_col``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, table = TaskContext.get().partitionId(), 0, id_table(vocabulary)
        for batch in batches:
            texts, keys = at.text_column(batch.column(1)), batch.column(0)
            nulls = np.asarray(keys.is_null(), dtype=np.uint8)
            keys = np.asarray(keys.fill_null(0), np.int64)
            for a, b in at.slices(texts):
                ids, edges = with_end(*table.values(*at.buffer_of(texts.slice(a, b - a))), end_id)
                row = {"shard": shard, "block": block, "n_tokens": len(ids), "doc_ids": keys[a:b].tobytes(), "doc_ends": edges[1:].astype("<i8").tobytes(), "doc_nulls": nulls[a:b].tobytes()}
                yield pa.RecordBatch.from_pylist([row | Codes.of(ids, widths).row()], schema=ARROW)
                block += 1

    keyed = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    # Rows of one id, or without one, are spread over tasks by their texts.
    ordered = keyed.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    ordered.mapInArrow(blocks, SCHEMA).write.parquet(path)


def blocks_at(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a file, each with the ids before it in the file."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = shards.withColumn("shard_start", F.sum("shard_tokens").over(Window.orderBy("shard")) - F.col("shard_tokens"))
    within = Window.partitionBy("shard").orderBy("block")
    starts = blocks.select("shard", "block", (F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("in_shard"))
    starts = starts.join(before, "shard").select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("block_start"))
    return blocks.join(small(stored(starts, "starts")), ["shard", "block"])  # the blocks themselves stay where they are while there are few


def documents_at(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Reads a file back, one row per document: doc_id, start, n_tokens, ids_crc32, and ``ids`` if asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes.from_row(row)
                ids = codes.get(np.arange(row["n_tokens"])).astype("<u4")
                ends = np.frombuffer(row["doc_ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                out = [
                    pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], np.uint8) > 0),
                    pa.array(starts + row["block_start"]), pa.array(ends - starts),
                    pa.array([zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist())], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.array([ids[s:e] for s, e in zip(starts.tolist(), ends.tolist())], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks_at(spark, path).mapInArrow(read, schema)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, position_col: str = "position") -> DataFrame:
    """Random access: the id at each position of the whole file (null outside it), decoding no other id.

    Positions are joined to blocks by number: a position looks for the block that begins at or before it among the blocks
    of its own and the previous stretch of ``stretch`` ids.
    """
    blocks = blocks_at(spark, path)
    stretch = blocks.agg(F.max("n_tokens")).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wanted = np.array(row["wanted"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(Codes.from_row(row).get(wanted - row["block_start"]).astype(np.int64))], ["position", "id"])

    asked = positions.select(F.col(position_col).cast("long").alias("position")).where("position is not null").distinct()
    edges = blocks.select("shard", "block", "block_start", (F.col("block_start") + F.col("n_tokens")).alias("block_end"))
    edges = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("block_start") / stretch), F.floor((F.col("block_end") - 1) / stretch))))
    placed = asked.withColumn("cell", F.floor(F.col("position") / stretch)).join(edges, "cell").where("position >= block_start and position < block_end")
    wanted = placed.groupBy("shard", "block").agg(F.collect_list("position").alias("wanted"))  # at most the ids of a block
    found = blocks.join(wanted, ["shard", "block"]).mapInArrow(read, "position long, id long")
    return asked.join(found, "position", "left")
