"""SentencePiece ids of whole texts, and texts of ids, for byte-pair models with byte fallback.

**Encoding.** Texts become one flat array of symbols, one a character. It is cut wherever two neighbouring characters stand
side by side in no piece of the vocabulary, since no merge can ever cross such a place; with usual models that makes every
word a segment. Equal segments of a slice are encoded once. Then come rounds: every segment finds the least rank among its
neighbouring pairs (a segmented minimum) and merges that pair wherever it stands, from the left and without overlaps; the
arrays are compacted. Segments without a pair leave, and a segment parts for good where two neighbouring symbols stand side by
side in no piece, so a word of a million letters soon falls apart. The library merges one pair at a time, the best of the
whole text, the leftmost of equals. Merging all pairs of one rank at once gives the same unless a merged piece and a neighbour
form a pair of no higher rank; a segment's round ends with the first such merge. The vocabulary tells in advance for which
ranks that has to be looked at. Characters outside the vocabulary become the pieces of their bytes.

**Decoding.** Every id stands for some bytes, gathered for all ids at once. The space before a text goes; bytes that are no
UTF-8 become U+FFFD one by one.

Empty and null texts hold the begin and end ids alone and decode to an empty text. Bytes of a text that are no UTF-8 count as
U+FFFD. Texts longer than a slice are worked off in spans that begin at a space, so memory follows the longest word
and not the longest text. Repeated rows, null or repeated doc_ids are rows of their own; extra columns are not read. An empty
table gives no rows. Models with a normalisation table, user-defined pieces or without byte fallback are refused.
"""

from __future__ import annotations

import codecs
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at

SLICE = 1 << 20
SPACE = 0x2581  # what stands for a space in pieces
NONE = np.int32(1 << 30)  # the rank of pairs that form no piece
APART = -2  # what neighbours form that stand together in no piece, and so can never become one
JOINED_BITS = 24

codecs.register_error("sentence-pieces", lambda e: ("�", e.start + 1))


def _message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while i < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[i : i + size]
            i += size


class Model:
    """A model file as arrays: which pairs form which piece, which neighbours some piece holds, which bytes an id stands for."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            parts = dict(_message(f.read()))  # the last of each field: fields 2 and 3 occur once
        trained, norm = dict(_message(parts[2])), dict(_message(parts.get(3, b"")))
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in ids]
        self.bytes_at = next(i for i in ids if sp.is_byte(i)) if any(sp.is_byte(i) for i in ids) else -1
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        whole = self.bytes_at >= 0 and all(names[self.bytes_at + b] == f"<0x{b:02X}>" for b in range(256))
        if trained.get(3) != 2 or not whole or norm.get(2) or norm.get(3, 1) != 1 or norm.get(4, 1) != 0 or norm.get(5, 1) != 1 or trained.get(24) or any(sp.is_unused(i) for i in plain):
            raise ValueError("only byte-pair models with byte fallback and without normalisation are known")
        self.begin, self.end = sp.bos_id(), sp.eos_id()

        numbers = {names[i]: i for i in plain}
        for c in sorted({c for w in numbers for c in w} - set(numbers)):  # characters that are only parts of pieces
            numbers[c] = len(ids) + len(numbers) - len(plain)
        self.size = len(ids) + len(numbers) - len(plain)  # symbols from here on are characters that no piece holds
        score = np.array([sp.get_score(i) for i in plain])
        order, rank = np.unique(-score, return_inverse=True)
        ranks = dict(zip(plain, rank.tolist()))
        pairs = {}
        for i in plain:
            for k in range(1, len(names[i])):
                a, b = numbers.get(names[i][:k]), numbers.get(names[i][k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        risky = np.bincount(rank, minlength=len(order)) > 1
        for key, i in pairs.items():
            for part in divmod(key, self.size):
                if ranks.get(part, -1) >= ranks[i]:
                    risky[ranks[part]] = True
        self.risky = risky
        beside = dict.fromkeys(pairs, -1)  # neighbours that stand together in some piece, whether or not they are one
        for w in {w[i:j] for w in numbers for i in range(len(w)) for j in range(i + 2, len(w) + 1)}:
            for k in range(1, len(w)):
                a, b = numbers.get(w[:k]), numbers.get(w[k:])
                if a is not None and b is not None:
                    beside[a * self.size + b] = -1
        beside.update(pairs)
        self._fill(np.fromiter(beside, np.int64, len(beside)), np.fromiter(beside.values(), np.int32, len(beside)))
        self.ranks = np.full(len(ids) + 1, NONE, np.int32)  # the last one is that of no piece
        self.ranks[plain] = rank

        alphabet = sorted({c for w in numbers for c in w})
        self.symbols, self.classes = np.full(0x110000, -1, np.int32), np.zeros(0x110000, np.int32)
        for k, c in enumerate(alphabet, start=1):
            self.symbols[ord(c)], self.classes[ord(c)] = numbers[c], k
        self.alphabet = len(alphabet) + 1
        self.joined = np.zeros(1 << JOINED_BITS, bool)  # may say yes too often, never no
        text = np.array([ord(c) for w in numbers for c in w], np.int64)
        last = np.cumsum([len(w) for w in numbers])[:-1] - 1
        inner = np.ones(max(len(text) - 1, 0), bool)
        inner[last] = False
        self.joined[self._neighbours(self.classes[text])[inner]] = True
        space = self.classes[SPACE]
        self.spaced = not any(self.joined[self._neighbours(np.array([c, space]))][0] for c in range(self.alphabet) if c != space)

        surfaces = []
        for i in ids:
            if sp.is_control(i):
                surfaces.append(b"")
            elif sp.is_unknown(i):
                surfaces.append(sp.decode([i]).encode())
            else:
                surfaces.append(bytes([i - self.bytes_at]) if sp.is_byte(i) else names[i].replace(chr(SPACE), " ").encode())
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.counts = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.control = np.array([sp.is_control(i) for i in ids])
        self.byte = np.array([sp.is_byte(i) for i in ids])
        self.led = np.array([names[i].startswith(chr(SPACE)) for i in ids]) & ~self.control & ~self.byte

    def _neighbours(self, classes: np.ndarray) -> np.ndarray:
        """The place of each pair of neighbours in ``joined``."""
        classes = classes.astype(np.int64)
        return (classes[:-1] * self.alphabet + classes[1:]) & ((1 << JOINED_BITS) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (at.mix64(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, formed: np.ndarray) -> None:
        """A hash table, at most half full, of the pairs ``keys`` and what they form."""
        self.bits = int(2 * len(keys)).bit_length()
        self.keys, self.formed = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, APART, np.int32)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] < 0
            taken, first = np.unique(np.where(free, slot, -1), return_index=True)
            taken, first = taken[taken >= 0], first[taken >= 0]
            self.keys[taken], self.formed[taken] = keys[first], formed[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, formed, slot = keys[rest], formed[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _pieces(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair forms: a piece, none (-1) or ``APART``; and the piece's rank."""
        keys = np.where((a < self.size) & (b < self.size), a.astype(np.int64) * self.size + b, self.size * self.size)
        slot = self._slots(keys)
        formed, held = self.formed[slot], self.keys[slot]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            formed[todo] = self.formed[slot[todo]]
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return formed, self.ranks[np.maximum(formed, -1)]

    def merge(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left when no pair of neighbours of one owner forms a piece, and their owners. ``owner`` ascends."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        symbols, formed, rank, last = symbols.astype(np.int32), np.full(len(symbols), -1, np.int32), np.full(len(symbols), NONE), np.ones(len(symbols), bool)
        place = np.arange(len(symbols))
        if len(symbols) > 1:
            formed[:-1], rank[:-1] = self._pieces(symbols[:-1], symbols[1:])
            last[:-1] = (owner[1:] != owner[:-1]) | (formed[:-1] == APART)
            rank[last] = NONE
        while len(symbols):
            starts = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])  # segments part for good where neighbours stand in no piece
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = least == NONE
            if over.any():
                done.append((symbols[gone := np.repeat(over, sizes)], place[gone]))
                symbols, place, formed, rank, last = (x[~gone] for x in (symbols, place, formed, rank, last))
                sizes, least = sizes[~over], least[~over]
                if not len(symbols):
                    break
            segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            best = least[segment]
            hit = np.flatnonzero(rank == best)
            nth = np.arange(len(hit))
            fresh = np.concatenate([[True], np.diff(hit) > 1])  # a run of hits is a piece beside itself: every other one merges
            hit = hit[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
            hit = hit[self._undisturbed(symbols, segment, formed, best, hit)]
            symbols[hit], last[hit] = formed[hit], last[hit + 1]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, place, formed, rank, last = (x[stay] for x in (symbols, place, formed, rank, last))
            hit -= np.arange(len(hit))
            changed = np.concatenate([hit, hit[hit > 0] - 1])
            rank[changed] = NONE
            changed = changed[~last[changed]]
            formed[changed], rank[changed] = self._pieces(symbols[changed], symbols[changed + 1])
            last[changed] = formed[changed] == APART
        symbols, place = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        order = np.argsort(place)
        return symbols[order].astype(np.int64), owner[place[order]]

    def _undisturbed(self, symbols: np.ndarray, owner: np.ndarray, formed: np.ndarray, best: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Which of the merges at ``hit`` come before anything else: from the left, up to and with the first one whose piece
        forms a pair of no higher rank with a neighbour."""
        keep = np.ones(len(hit), bool)
        again = np.concatenate([[False], owner[hit[1:]] == owner[hit[:-1]]])
        more = np.flatnonzero(self.risky[best[hit]] & (again | np.append(again[1:], False)))
        if not len(more):
            return keep
        at_, piece = hit[more], formed[hit[more]]
        beside = np.where(again[more] & (hit[more - 1] == at_ - 2), formed[hit[more - 1]], symbols[at_ - 1])  # what stands before, merged already or not
        before = np.where((at_ > 0) & (owner[at_ - 1] == owner[at_]), self._pieces(beside, piece)[1], NONE)
        next_ = np.minimum(at_ + 2, len(symbols) - 1)
        after = np.where((next_ == at_ + 2) & (owner[next_] == owner[at_]), self._pieces(piece, symbols[next_])[1], NONE)
        breaks = np.zeros(len(hit), np.int64)
        breaks[more] = np.minimum(before, after) <= best[at_]
        earlier = np.cumsum(breaks) - breaks
        first = np.flatnonzero(~again)
        return earlier == np.repeat(earlier[first], np.diff(np.append(first, len(hit))))

    def _ids(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary replaced by the pieces of their bytes."""
        odd = np.flatnonzero(symbols >= self.bytes_from)
        if not len(odd):
            return symbols, owner
        text = "".join(self.spelled(s) for s in symbols[odd].tolist())
        raw = np.frombuffer(text.encode(), np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        counts = np.ones(len(symbols), np.int64)
        counts[odd] = np.diff(np.append(lead, len(raw)))
        out, own = np.repeat(symbols, counts), np.repeat(owner, counts)
        out[np.repeat(symbols >= self.bytes_from, counts)] = raw.astype(np.int64) + self.bytes_at
        return out, own

    @property
    def bytes_from(self) -> int:
        return len(self.counts)

    def spelled(self, symbol: int) -> str:
        """The character of a symbol that is no piece."""
        return chr(symbol - self.size) if symbol >= self.size else chr(int(np.flatnonzero(self.symbols == symbol)[0]))

    def encode(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as characters with ``SPACE`` for spaces, one after another, and the n + 1 offsets of the texts in
        them. ``chars[offsets[i]:offsets[i + 1]]`` is text i."""
        if not len(chars):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        symbols = self.symbols[chars].astype(np.int64)
        symbols = np.where(symbols < 0, self.size + chars.astype(np.int64), symbols)
        cut = np.ones(len(chars), bool)
        cut[1:] = ~self.joined[self._neighbours(self.classes[chars])]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(chars)))
        place = np.arange(len(chars)) - np.repeat(starts, sizes)
        keys = np.add.reduceat(at.mix64(symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)), starts) + sizes.astype(np.uint64)
        _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        like = first[kind]  # for each segment, one that should be equal
        same = sizes[like] == sizes
        alike = symbols[np.minimum(np.repeat(starts[like], sizes) + place, len(chars) - 1)] == symbols
        same &= np.logical_and.reduceat(alike, starts)
        alone = np.flatnonzero(~same)  # a hash met twice: those stand for themselves
        kind[alone] = len(first) + np.arange(len(alone))
        chosen = np.concatenate([first, alone])
        found, owner = self._ids(*self.merge(symbols[at.ragged_index(starts[chosen], sizes[chosen])], np.repeat(np.arange(len(chosen)), sizes[chosen])))
        counts = np.bincount(owner, minlength=len(chosen))
        begins = np.cumsum(counts) - counts
        ids = found[at.ragged_index(begins[kind], counts[kind])]
        edges = np.concatenate([[0], np.cumsum(counts[kind])])
        return ids, edges[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The text of each run of ids as UTF-8."""
        size = self.counts[ids]
        raw = self.surface[at.ragged_index(self.starts[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])
        silent = np.concatenate([[0], np.cumsum(self.control[ids])])
        odd = np.concatenate([[0], np.cumsum(self.byte[ids])])
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            while a < b and self.control[ids[a]]:
                a += 1
            while a < b and self.control[ids[b - 1]]:
                b -= 1
            if a == b:
                out.append(b"")
                continue
            text = raw[ends[a] + int(self.led[ids[a]]) : ends[b]]
            if odd[b] > odd[a]:
                try:
                    whole = silent[a] == silent[b]
                    text.decode()
                except UnicodeDecodeError:
                    whole = False
                if not whole:
                    text = self._by_runs(ids[a:b])
            out.append(text)
        return out

    def _by_runs(self, ids: np.ndarray) -> bytes:
        """The text of ids among which bytes are no UTF-8 or other ids part them."""
        kind = self.byte[ids]
        cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(ids)]])
        cuts = np.unique(np.concatenate([cuts, np.flatnonzero(self.control[ids]), np.flatnonzero(self.control[ids]) + 1]))
        parts = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = ids[a:b]
            part = self.surface[at.ragged_index(self.starts[own], self.counts[own])].tobytes()
            parts.append(part.decode("utf-8", "sentence-pieces").encode() if kind[a] else part[int(a == 0 and self.led[own[0]]) :])
        return b"".join(parts)


@functools.lru_cache(maxsize=2)
def model_at(path: str) -> Model:
    return Model(path)


def _characters(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def spans(texts: pa.Array, spaced: bool, size: int = SLICE) -> Iterator[tuple[int, list[bytes], bool]]:
    """The texts in slices: (row of the first, bytes of each, whether they begin texts). A text beyond ``size`` comes alone, in spans that
    begin before a space that follows something else."""
    for a, b in at.slices(texts, size):
        own = [x.as_buffer().to_pybytes() for x in texts.slice(a, b - a)]
        if b > a + 1 or len(own[0]) <= size or not spaced:
            yield a, own, True
            continue
        raw, start = own[0], 0
        while start < len(raw):
            end = start + size
            while end < len(raw) and not (raw[end] == 32 and raw[end - 1] != 32):
                end = raw.find(b" ", end + 1)
                end = len(raw) if end < 0 else end
            yield a, [raw[start:end]], start == 0
            start = end


def encoded(model: Model, texts: pa.Array, with_text: bool) -> Iterator[tuple[np.ndarray, list[bytes | None]]]:
    """Per text, in order: its ids with begin and end, and the text that they decode to."""

    def whole(ids: list[np.ndarray]) -> tuple[np.ndarray, bytes | None]:
        own = np.concatenate([[model.begin], *ids, [model.end]])
        return own, model.decode(own, np.array([0, len(own)]))[0] if with_text else None

    last, held = -1, []
    for row, own, fresh in spans(texts, model.spaced):
        if fresh and held:
            yield whole(held)
            held = []
        chars = [_characters(raw) for raw in own]
        parts = [x for c in chars for x in ((_LEAD, c) if fresh and len(c) else (c,))]
        flat = np.concatenate(parts)
        flat = np.where(flat == 32, SPACE, flat)
        lengths = np.array([len(c) + (fresh and len(c) > 0) for c in chars], np.int64)
        ids, edges = model.encode(flat, np.concatenate([[0], np.cumsum(lengths)]))
        if len(own) == 1:
            held.append(ids)
            last = row
            continue
        n = np.diff(edges)
        out = np.full(len(ids) + 2 * len(own), model.begin, np.int64)
        bounds = np.concatenate([[0], np.cumsum(n + 2)])
        out[at.ragged_index(bounds[:-1] + 1, n)] = ids
        out[bounds[1:] - 1] = model.end
        texts_of = model.decode(out, bounds) if with_text else [None] * len(own)
        for k in range(len(own)):
            yield out[bounds[k] : bounds[k + 1]], texts_of[k]
    if held:
        yield whole(held)


_LEAD = np.array([SPACE], "<u4")


def encode(docs: DataFrame, model: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, ids (begin and end included, unsigned 32-bit little-endian, binary) and, if asked for, the text that
    the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_at(model)
        for batch in batches:
            keys, ids, back, held, first = batch.column(0), [], [], 0, 0

            def out() -> pa.RecordBatch:
                columns = [keys.slice(first, len(ids)), pa.array(ids, pa.binary())] + [pa.array(back, pa.binary()).cast(pa.string())] * decoded
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: 2 + decoded])

            for found, text in encoded(own, at.text_column(batch.column(1)), decoded):
                ids.append(found.astype("<u4").tobytes())
                back.append(text)
                held += len(ids[-1])
                if held > 4 * SLICE:
                    yield out()
                    first, held, ids, back = first + len(ids), 0, [], []
            yield out()

    schema = "doc_id long, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of its ids (unsigned 32-bit little-endian, binary; null ids give a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_at(model)
        for batch in batches:
            found = [np.frombuffer(x, "<u4").astype(np.int64) if x is not None else np.zeros(0, np.int64) for x in batch.column(1).to_pylist()]
            edges = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            texts = own.decode(np.concatenate([*found, np.zeros(0, np.int64)]), edges)
            column = pa.array([None if null else t for t, null in zip(texts, batch.column(1).is_null().to_pylist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("k"), F.col(ids_col).alias("t")).mapInArrow(run, "doc_id long, text string")
