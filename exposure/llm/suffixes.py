"""Removal of long repeated byte strings by longest-previous-factor arrays.

A byte is repeated if some string of ``LENGTH`` bytes that covers it also starts elsewhere, in another text or the same.

1. Every window of ``LENGTH`` bytes is assigned to its smallest ``GRAM``-byte hash, its anchor, which only its own bytes
   decide: equal windows have equal anchors at equal places. The windows of one anchor are a run of starts, and all they
   see is one stretch of bytes, the context. One row a context leaves a task, about one for 80 bytes.
2. Contexts whose anchor occurs once in the corpus are done. Contexts that are equal as a whole are repeated as a whole;
   counts summed before the shuffle tell, and one of them stands for all.
3. What is left are different contexts around one anchor: the ends of matches. They are put together by anchor, and the
   suffixes of their joined bytes are sorted by prefix doubling to the depth of a window. Previous and next smaller
   positions in suffix order give each suffix its earlier match, and the lengths of these matches are the longest
   previous factors; with the order of positions reversed they are the later matches. A window is a copy if its factor is
   a whole window long. An anchor with more than ``CROWD`` different contexts isn't gathered in a task; its windows are
   counted by their contents instead, which is the same question for one length.

``keep="first"`` removes copies of what occurs earlier, texts in order of (doc_id, MD5 of the text), null ids first, and positions in them;
``keep="none"`` removes every occurrence of what occurs more than once.

A null text counts as empty. Texts shorter than ``LENGTH`` bytes are kept whole. A text is known by its doc_id and the 128 bits of its MD5, so rows
that share a doc_id, or have none, are texts of their own if they differ; rows alike in both are copies of each other for ``keep="none"``, and keep
or lose the same bytes for ``keep="first"``. An empty table gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm.minhash import whole_groups
from exposure.llm.shared import stored

LENGTH, GRAM = 200, 40
CROWD = 4096
#: Contexts whose suffixes are sorted together.
TOGETHER = 4000

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)


class Rolling:
    """Hashes of any stretch of a buffer, from sums over its prefixes."""

    _table = np.random.default_rng(4).integers(0, 1 << 63, 256, np.uint64)
    _up, _down = _powers(_FACTOR, 1 << 12), _powers(_INVERSE, 1 << 12)

    def __init__(self, buf: np.ndarray):
        if len(buf) >= len(self._up):  # of this buffer only: a worker that kept them would hold 16 bytes for each of the longest one
            self._up, self._down = _powers(_FACTOR, len(buf)), _powers(_INVERSE, len(buf))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self._table[buf] * self._up[: len(buf)], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        d = self.sums[width:] - self.sums[:-width]
        return at.mix64(d * self._down[: len(d)])

    def some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return at.mix64((self.sums[ends] - self.sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def anchor_runs(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: text, first start, last start, anchor, hash of the anchor's bytes, hash of
    the context."""
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(buf)
    hashes = rolling.all(gram)
    bits = np.uint64(len(hashes)).item().bit_length()
    low = np.uint64((1 << bits) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    windows = np.maximum(sizes - length + 1, 0)
    starts = at.ragged_index(offsets[:-1], windows)
    text = np.repeat(np.arange(len(sizes)), windows)
    anchor = (best[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(starts)) - 1
    s, e, p = starts[first], starts[last], anchor[first]
    return text[first], s, e, p, hashes[p], rolling.some(s, e + length)


ANCHORS = "doc_id long, crc binary, start long, reach int, lead int, gram long, context long"


def anchors(docs: DataFrame) -> DataFrame:
    """One row per context: its text, first window start, number of further starts (``reach``), bytes before the anchor
    (``lead``) and the hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, sums = at.text_column(batch.column("text")), batch.column("doc_id"), batch.column("crc")
            for a, b in at.slices(texts, 1 << 20):
                part = texts.slice(a, b - a)
                buf, offsets = at.buffer_of(part)
                text, s, e, p, gram, context = anchor_runs(buf, offsets)
                rows = pa.array(text + a)
                columns = [ids.take(rows), sums.take(rows), s - offsets[text], (e - s).astype(np.int32), (p - s).astype(np.int32), gram.astype(np.int64), context.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in ANCHORS.split(", ")])

    return docs.select("doc_id", "crc", "text").mapInArrow(at.lean(find), ANCHORS)


def ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(depth, ranks of all suffixes by their first so many bytes), doubling from 8 up to ``depth`` (8 at least)."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    words = np.ndarray((len(text),), ">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    out, now = [(8, rank)], 8
    while now < depth:
        step = min(now, depth - now)
        ahead = np.zeros(len(rank), np.int64)
        ahead[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        now += step
        out.append((now, rank))
    return out


def common(levels: list[tuple[int, np.ndarray]], text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes ``a`` and ``b``, up to the depth of the ranks."""
    top, n = levels[-1][0], len(text)
    out = np.zeros(len(a), np.int64)
    for depth, rank in reversed(levels):
        x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        fits = (a + out + depth <= n) & (b + out + depth <= n) & (out + depth <= top)
        out = np.where(fits & (rank[x] == rank[y]), out + depth, out)
    for _ in range(levels[0][0] * 2):
        x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
        out = np.where((a + out < n) & (b + out < n) & (out < top) & (text[x] == text[y]), out + 1, out)
    return out


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1. What lies between a place and its guess is
    always larger, so a guess that is larger itself passes its own guess on."""
    guess = np.arange(len(values)) - 1
    todo = np.flatnonzero(guess >= 0)
    while len(todo := todo[(guess[todo] >= 0)]):
        todo = todo[values[guess[todo]] > values[todo]]
        if not len(todo):
            break
        guess[todo] = guess[guess[todo]]
    return guess


def previous_factors(levels, text: np.ndarray, order: np.ndarray, later: bool = False) -> np.ndarray:
    """For each suffix of ``order`` (positions in suffix order) the length of its longest earlier match among them (or
    later match), up to the depth of the ranks."""
    position = -order if later else order
    before = nearest_smaller(position)
    after = len(order) - 1 - nearest_smaller(position[::-1])[::-1]
    out = np.zeros(len(order), np.int64)
    for near in (before, np.where(after > len(order) - 1, -1, after)):
        has = np.flatnonzero(near >= 0)
        out[has] = np.maximum(out[has], common(levels, text, order[has], order[near[has]]))
    return out


def copied_windows(contexts: list[bytes], reach: np.ndarray, length: int = LENGTH, later: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts in ``contexts`` whose window also occurs earlier in them (or, with ``later``, anywhere else):
    context, first start, last start."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    levels = ranks(text, length)
    windows = at.ragged_index(begin, reach + 1)
    order = windows[np.argsort(levels[-1][1][windows], kind="stable")]  # a stable sort leaves equal ones in text order
    factor = previous_factors(levels, text, order)
    if later:
        factor = np.maximum(factor, previous_factors(levels, text, order, later=True))
    found = np.sort(order[factor >= length])
    owner = np.searchsorted(begin, found, "right") - 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(found) > 1) | (np.diff(owner) > 0)])) if len(found) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(found)) - 1 if len(found) else first
    return owner[first], found[first] - begin[owner[first]], found[last] - begin[owner[first]]


KEY = ["gram", "context", "lead", "reach"]


NO_ID = -(1 << 63)


def text_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """What a text is known and ordered by, never null: its id (a number below all others for none) and the MD5 of its bytes. No text ends in the byte
    that tells a null id from one that is that number."""
    doc_id, text = doc_id.cast("long"), F.coalesce(text, F.lit("")).cast("binary")
    return F.coalesce(doc_id, F.lit(NO_ID)), F.unhex(F.md5(F.when(doc_id.isNull(), F.concat(text, F.lit(b"\xff"))).otherwise(text)))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and crc as ``text_key`` has them, no_id (whether the id is null) and text."""
    doc_id, crc = text_key(F.col(id_col), F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(doc_id.alias("doc_id"), crc.alias("crc"), F.col(id_col).isNull().alias("no_id"), text.alias("text"))


def with_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``rows`` of (doc_id, crc, ...) beside their texts."""
    texts = docs.select(F.col("doc_id").alias("d"), F.col("crc").alias("c"), "no_id", "text")
    return texts.join(rows, (texts["d"] == rows["doc_id"]) & (texts["c"] == rows["crc"]), how)


def partial_matches(docs: DataFrame, classes: DataFrame, later: bool) -> DataFrame:
    """Copied windows of contexts that share their anchor with different ones: KEY, first, last (starts from that of the
    context). ``classes`` has KEY, n and the place (doc_id, crc, start) of the first context of each class."""
    kinds = classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single"))
    open_ = kinds.where(F.col("kinds") > 1)
    if later:  # classes of several are repeated as a whole already
        open_ = open_.where(F.col("single") > 0)
    wanted = classes.join(open_, "gram")
    here = F.col("doc_id"), F.col("crc")
    places = wanted.groupBy(*here).agg(F.collect_list(F.struct(*KEY, "n", "kinds", "start")).alias("at"))  # within a text
    rows = with_text(docs, places, "inner").select("doc_id", "crc", "text", F.explode("at").alias("x")).select("doc_id", "crc", "x.*", F.expr(f"substring(text, cast(x.start + 1 as int), x.reach + {LENGTH})").alias("bytes"))
    rows = stored(rows.dropDuplicates([*KEY]), "contexts")
    few, many = rows.where(F.col("kinds") <= CROWD), rows.where(F.col("kinds") > CROWD)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve() -> pa.RecordBatch:
            t = pa.concat_tables(held)
            t = t.sort_by([("doc_id", "ascending"), ("crc", "ascending"), ("start", "ascending")])
            owner, first, last = copied_windows(t.column("bytes").to_pylist(), np.asarray(t.column("reach")).astype(np.int64), later=later)
            picked = t.select(KEY).take(pa.array(owner)).combine_chunks()
            columns = [picked.column(c).combine_chunks() if picked.num_rows else pa.array([], picked.schema.field(c).type) for c in KEY]
            return pa.RecordBatch.from_arrays([*columns, pa.array(first), pa.array(last)], [*KEY, "first", "last"])

        for group in whole_groups(batches, ["gram"]):
            held.append(group)
            if sum(t.num_rows for t in held) >= TOGETHER:
                yield solve()
                held.clear()
        if held:
            yield solve()

    sorted_ = few.repartition("gram").sortWithinPartitions("gram").select("doc_id", "crc", "start", *KEY, "bytes").mapInArrow(at.lean(sort), "gram long, context long, lead int, reach int, first long, last long")

    window = F.expr(f"substring(bytes, cast(j + 1 as int), {LENGTH})")
    opened = many.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("reach")))).select("doc_id", "crc", "start", *KEY, "j", F.xxhash64(window).alias("w1"), F.xxhash64(window, F.lit(1)).alias("w2"))
    place = F.struct("doc_id", "crc", F.col("start") + F.col("j"))
    counted = opened.groupBy("gram", "w1", "w2").agg(F.count("*").alias("times"), F.min(place).alias("earliest")).where("times > 1")
    crowded = opened.join(counted, ["gram", "w1", "w2"])
    if not later:
        crowded = crowded.where(place != F.col("earliest"))
    return sorted_.union(crowded.select(*KEY, F.col("j").cast("long").alias("first"), F.col("j").cast("long").alias("last")))


#: What a range of ``repeated`` says: these bytes go; a whole context that goes unless it is exempt; that one is exempt.
PART, WHOLE, EXEMPT = 0, 1, 2


def repeated(docs: DataFrame, keep: str) -> DataFrame:
    """Byte ranges of texts (they may overlap): doc_id, crc, lo, hi, kind. ``docs`` as ``keyed`` gives it.

    Every context whose anchor occurs again is returned as a whole, from its own row and without a join by its contents, so copies that all
    texts share cost what other contexts do. One context stands for each class of equal ones. It is returned once more as exempt if it is
    kept, that is if it is the first (``keep="first"``) or the only one (``keep="none"``), and what of it occurs in other classes as parts."""
    found = stored(anchors(docs), "anchors")
    again = stored(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "again")  # so that the join below may split a frequent anchor
    found = stored(found.join(again, "gram", "left_semi"), "repeated")
    classes = found.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "crc", "start")).alias("place"))
    classes = stored(classes.select(*KEY, "n", "place.*"), "classes")
    parts = partial_matches(docs, classes, later=keep == "none")
    kept = classes.where("n = 1") if keep == "none" else classes
    bounds = lambda df, first, last, kind: df.select("doc_id", "crc", (F.col("start") + first).alias("lo"), (F.col("start") + last + LENGTH).alias("hi"), F.lit(kind).alias("kind"))
    whole = lambda df, kind: bounds(df, F.lit(0), F.col("reach"), kind)
    return bounds(parts.join(kept, KEY), F.col("first"), F.col("last"), PART).union(whole(found, WHOLE)).union(whole(kept, EXEMPT))


def text_ranges(ranges: DataFrame) -> DataFrame:
    """doc_id, crc and ``ranges``, all of a text."""
    return ranges.groupBy("doc_id", "crc").agg(F.collect_set(F.struct("lo", "hi", "kind")).alias("ranges"))


def removed(found) -> tuple[np.ndarray, np.ndarray]:
    """What goes of a text, from the structs of ``text_ranges`` or None. Contexts of a text begin at different places, by which an exempt one is known."""
    if found is None or not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi, kind = (found.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "hi", "kind"))
    goes = (kind == PART) | ((kind == WHOLE) & ~np.isin(lo, lo[kind == EXEMPT]))
    return merged(lo[goes], hi[goes])


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges apart from each other (ranges that touch become one)."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate([[True], lo[1:] > top[:-1]])
    return lo[first], top[np.append(np.flatnonzero(first)[1:], len(lo)) - 1]


def deduplicate(docs: DataFrame, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with ``with_kept`` the
    bytes left (``kept``, binary) and a checksum of the input (``crc``)."""
    base = keyed(docs, id_col, text_col)
    ranges = text_ranges(repeated(base, keep))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "crc"] * with_kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ranges = batch.column("ranges")
            for i, raw in enumerate(batch.column("text")):
                raw = memoryview(raw.as_buffer())
                lo, hi = removed(ranges[i].values)
                digest, left, at_ = hashlib.sha256(), [], 0
                for s, e in [*zip(lo.tolist(), hi.tolist()), (len(raw), len(raw))]:
                    left.append(raw[at_:s])
                    digest.update(left[-1])
                    at_ = e
                row = (len(raw), int((hi - lo).sum()), len(lo), digest.hexdigest())
                rows.append((*row, b"".join(left)) if with_kept else row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_kept
            columns = [batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))] + [batch.column("crc")] * with_kept
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, crc long" * with_kept
    doc_id = F.when(~F.col("no_id"), F.col("d")).alias("doc_id")
    return with_text(base, ranges, "left").select(doc_id, F.crc32("text").alias("crc"), "text", "ranges").mapInArrow(at.lean(cut), schema)


def without_repeats(docs: DataFrame, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text_col``, all other columns as they are (``chars_col``: the new number
    of characters). A character goes only if all its bytes do. A row of whose text nothing but white space is left by the
    cuts is dropped; a text without cuts, null included, stays as it is."""
    base = keyed(docs, id_col, text_col)
    ranges = text_ranges(repeated(base, keep)).select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), F.col("ranges").alias("_ranges"))
    doc_id, crc = text_key(F.col(id_col), F.col(text_col))
    joined = docs.withColumns({"_own_id": doc_id, "_own_crc": crc}).join(ranges, (F.col("_own_id") == F.col("_id")) & (F.col("_own_crc") == F.col("_crc")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ranges = batch.column(text_col).to_pylist(), batch.column("_ranges")
            stay = np.ones(len(texts), bool)
            for i, text in enumerate(texts):
                lo, hi = removed(ranges[i].values)
                if text is None or not len(lo):
                    continue
                raw, left, at_ = text.encode(), [], 0
                for s, e in zip(lo.tolist(), hi.tolist()):
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
                        e -= 1
                    left.append(raw[at_:s])
                    at_ = e
                texts[i] = b"".join([*left, raw[at_:]]).decode()
                stay[i] = bool(texts[i].strip())
            columns = []
            for field in batch.schema:
                if field.name in ("_ranges",):
                    continue
                if field.name == text_col:
                    columns.append(pa.array(texts, pa.string()))
                elif field.name == chars_col:
                    columns.append(pa.array([None if t is None else len(t) for t in texts], field.type))
                else:
                    columns.append(batch.column(field.name))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in batch.schema if f.name != "_ranges"]).filter(pa.array(stay))

    return joined.select(*docs.columns, "_ranges").mapInArrow(at.lean(cut), docs.schema)
