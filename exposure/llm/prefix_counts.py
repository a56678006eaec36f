"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix is the only vocabulary entry that ends it and whose pair with the last token of what stands
before it encodes to just that pair. Going over a word once thus gives the last token and the number of tokens of all its
prefixes. Counts of a text's prefixes are those of its pieces, one added to the next; a piece (white space and what
follows it) is worked out once and kept in a table of fixed size. Budgets, truncation points and totals are then read off
without encoding anything again.

Counts are those of ``Tokenizer.encode`` without added special tokens, special strings inside texts being one token, for
byte-level vocabularies whose words are split by ``SPLIT``. A prefix that ends inside a character has the count of the last
whole one. Null and empty texts have no tokens. Repeated rows are counted one by one; extra columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm import arrow_text as at
from exposure.llm.tokens import PieceTable, pieces, vocabulary

# Fixed value: the split of byte-level vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer words are cut into spans that are worked off side by side.
WIDE = 48
#: Least and greatest length of a span, the bytes before it that it is read with, and spans worked off at once.
SPANS, LEAD, AT_ONCE = (256, 2048), 256, 256
#: Fewer words or spans than this are gone over one by one.
FEW = 24
PAIR_BITS = 20
SEEN_BITS = 18
#: Pairs of tokens kept by the walk over single words.
KNOWN_PAIRS = 1 << 18


class PrefixCounter:
    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        if self.vocabulary.word_ends:
            raise ValueError("prefix counts need a byte-level vocabulary")
        self.model = self.vocabulary.tokenizer.model
        symbol = {s: b for b, s in enumerate(self.vocabulary.symbols)}
        words = {bytes(symbol[c] for c in token): i for token, i in self.vocabulary.spec["model"]["vocab"].items() if all(c in symbol for c in token)}
        self.ids = words
        self.bytes = {i: b for b, i in words.items()}
        self.longest = max(map(len, words))
        self.short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in range(1, 17):
            own = [(b, i) for b, i in words.items() if len(b) == length]
            if own:
                first = np.array([int.from_bytes(b[:8], "little") for b, _ in own], np.uint64)
                last = np.array([int.from_bytes(b[-8:], "little") if length > 8 else 0 for b, _ in own], np.uint64)
                key = at.mix64(first + at.mix64(last))
                order = np.argsort(key)
                seen = np.zeros(1 << SEEN_BITS, bool)
                seen[(key >> np.uint64(64 - SEEN_BITS)).astype(np.int64)] = True
                self.short[length] = key[order], np.stack([first[order], last[order]]), np.array([i for _, i in own], np.int64)[order], seen
        self.tails: dict[bytes, list[int]] = {}  # lengths of tokens by their last two bytes, and of those over 16 by their last 16
        for tail, over in ((2, 1), (16, 16)):
            for b in words:
                if len(b) > over:
                    self.tails.setdefault(b[-tail:], []).append(len(b))
        self.tails = {b: sorted(set(n), reverse=True) for b, n in self.tails.items()}
        ends = np.array([[int.from_bytes(b[:8], "little"), int.from_bytes(b[8:], "little")] for b in self.tails if len(b) == 16], np.uint64).reshape(-1, 2)
        self.tail_keys = np.sort(at.mix64(ends[:, 0] + at.mix64(ends[:, 1])))
        self.known: dict[tuple[int, int], bool] = {}
        self.pair_key, self.pair_fits = np.zeros(1 << PAIR_BITS, np.uint64), np.zeros(1 << PAIR_BITS, bool)
        self.special = [s for s in self.vocabulary.special]
        self.split = regex.compile(SPLIT)
        self.special_split = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def _encodes_to(self, left: int, right: int) -> bool:
        """Whether the pair encodes to itself; ``left`` is -1 for a token at the start."""
        raw = (self.bytes[left] if left >= 0 else b"") + self.bytes[right]
        found = [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.vocabulary.table))]
        return found == ([left, right] if left >= 0 else [right])

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = ((left + 1).astype(np.uint64) << np.uint64(24)) + right.astype(np.uint64) + np.uint64(1)
        slot = (at.mix64(key) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, todo = np.zeros(len(key), bool), np.arange(len(key))
        while len(todo):
            hit = self.pair_key[slot[todo]] == key[todo]
            out[todo[hit]] = self.pair_fits[slot[todo[hit]]]
            todo = todo[~hit]
            if len(todo):
                taken, first = np.unique(slot[todo], return_index=True)
                new = todo[first]
                self.pair_fits[taken] = [self._encodes_to(a, b) for a, b in zip(left[new].tolist(), right[new].tolist())]
                self.pair_key[taken] = key[new]
        return out

    def _tokens(self, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
        """Ids of byte strings of one length up to 16, or -1."""
        if length not in self.short:
            return np.full(len(first), -1)
        keys, parts, ids, seen = self.short[length]
        key = at.mix64(first + at.mix64(last))
        out, held = np.full(len(first), -1), np.flatnonzero(seen[(key >> np.uint64(64 - SEEN_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, key[held]), len(keys) - 1)
        out[held] = np.where((parts[0][place] == first[held]) & (parts[1][place] == last[held]), ids[place], -1)
        return out

    def _fits_one(self, left: int, right: int) -> bool:
        if (left, right) not in self.known:
            if len(self.known) >= KNOWN_PAIRS:
                self.known.clear()
            self.known[left, right] = self._encodes_to(left, right)
        return self.known[left, right]

    def _step(self, word: bytes, i: int, last, count, lengths: list[int]) -> bool:
        """Sets the last token and the count of the prefix of ``i`` bytes by the first length that fits."""
        for length in lengths:
            if length <= i:
                token = self.ids.get(word[i - length : i])
                if token is not None and self._fits_one(int(last[i - length]), token):
                    last[i], count[i] = token, count[i - length] + 1
                    return True
        return False

    def _walk(self, word: bytes, last, count, i: int) -> None:
        self._step(word, i, last, count, [*self.tails.get(word[max(i - 2, 0) : i], ()), 1])

    def _one(self, word: bytes) -> np.ndarray:
        last, count = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for i in range(1, len(word) + 1):
            self._walk(word, last, count, i)
        return np.array(count[1:], np.int32)

    def _spans(self, word: bytes) -> np.ndarray:
        """The counts of a long word from spans read with some bytes before them.

        What follows a stretch as long as the longest token depends on nothing before it, so a span whose last tokens are
        the word's over such a stretch, with counts that differ by one number, goes on as the word does. Where the bytes
        before a span were too few for that, the word is walked on until they agree.
        """
        size = SPANS[0]
        while size < SPANS[1] and size * 256 < len(word):
            size *= 2
        last, count = np.full(len(word) + 1, -1, np.int64), np.zeros(len(word) + 1, np.int32)
        starts = range(0, len(word), size)
        for group in range(0, len(starts), AT_ONCE):
            own = starts[group : group + AT_ONCE]
            spans = [word[max(s - LEAD, 0) : s + size] for s in own]
            lasts, counts = self._side_by_side(spans)
            for s, span, l, c in zip(own, spans, lasts, counts):
                base, done = max(s - LEAD, 0), s
                end = base + len(span)
                l, c = l[: len(span) + 1], c[: len(span) + 1]
                if s == 0:
                    last[:end + 1], count[:end + 1] = l, c
                    continue
                low = max(s - self.longest + 1, base)
                agreed = self._agreed(last[low : s + 1], count[low : s + 1], l[low - base : s - base + 1], c[low - base : s - base + 1])
                while agreed < self.longest and done < end:
                    done += 1
                    self._walk(word, last, count, done)
                    same = last[done] == l[done - base] and (agreed == 0 or count[done] - c[done - base] == count[done - 1] - c[done - 1 - base])
                    agreed = agreed + 1 if same else int(last[done] == l[done - base])
                last[done + 1 : end + 1] = l[done - base + 1 :]
                count[done + 1 : end + 1] = c[done - base + 1 :] + (count[done] - c[done - base])
        return count[1:]

    @staticmethod
    def _agreed(last: np.ndarray, count: np.ndarray, other: np.ndarray, other_count: np.ndarray) -> int:
        """How many places at the end have the same last token and one difference of counts."""
        apart = count - other_count
        wrong = np.flatnonzero((last != other) | (apart != apart[-1]))
        return len(last) - 1 - int(wrong[-1]) if len(wrong) else len(last)

    def _ending(self, view: np.ndarray, size: int) -> np.ndarray:
        """Ids of the tokens of each length up to 16 that end before each byte, or -1."""
        out, end = np.full((17, size), -1, np.int32), np.arange(16, size - 15)
        for length in range(1, 17):
            first = view[end - length]
            if length < 8:
                first = first & np.uint64((1 << (8 * length)) - 1)
            out[length, end] = self._tokens(first, view[end - 8] if length > 8 else np.zeros(len(end), np.uint64), length)
        return out

    def _side_by_side(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Last tokens and counts of all prefixes of all words, a byte of every word at a time."""
        sizes = np.array([len(w) for w in found])
        buf = np.frombuffer(b"\0" * 16 + b"".join(found) + b"\0" * 16, np.uint8)
        begin = 16 + np.cumsum(sizes) - sizes
        view = at.words_view(buf)
        ending = self._ending(view, len(buf))
        top = int(sizes.max())
        last, count = np.full((len(found), top + 1), -1, np.int64), np.zeros((len(found), top + 1), np.int32)
        for i in range(1, top + 1):
            todo = np.flatnonzero(sizes >= i)
            end = begin[todo] + i
            if i > 16 and len(self.tail_keys):
                key = at.mix64(view[end - 16] + at.mix64(view[end - 8]))
                held = np.flatnonzero(self.tail_keys[np.minimum(np.searchsorted(self.tail_keys, key), len(self.tail_keys) - 1)] == key)
                done = [n for n in held.tolist() if self._step(found[todo[n]], i, last[todo[n]], count[todo[n]], self.tails.get(buf[end[n] - 16 : end[n]].tobytes(), ()))]
                if done:
                    todo, end = np.delete(todo, done), np.delete(end, done)
            for length in range(min(i, self.longest, 16), 0, -1):
                if not len(todo):
                    break
                token = ending[length, end]
                good = token >= 0
                if not good.any():
                    continue
                good[good] = self.fits(last[todo[good], i - length], token[good])
                row = todo[good]
                last[row, i], count[row, i] = token[good], count[row, i - length] + 1
                todo, end = todo[~good], end[~good]
        return last, count

    def words(self, found: list[bytes]) -> list[np.ndarray]:
        """For each word the counts of its prefixes of 1, 2, ... bytes."""
        out: list = [None] * len(found)
        many = [k for k, w in enumerate(found) if len(w) <= WIDE]
        for k in set(range(len(found))) - set(many):
            out[k] = self._spans(found[k]) if len(found[k]) > FEW * SPANS[0] else self._one(found[k])
        if len(many) < FEW:
            for k in many:
                out[k] = self._one(found[k])
            return out
        _, counts = self._side_by_side([found[k] for k in many])
        for k, row in zip(many, counts):
            out[k] = row[1 : len(found[k]) + 1]
        return out

    def piece_parts(self, text: str) -> list[tuple[str, bytes]]:
        """What a piece's counts are made of: words in order, each with how its prefixes are read."""
        parts: list[tuple[str, bytes]] = []
        spaces = 0
        for m in self.split.finditer(text):
            word = m.group()
            if regex.fullmatch(r"\s+", word) and m.start() >= spaces:
                run = regex.match(r"\s+", text[m.start() :]).group()
                spaces = m.start() + len(run)
                parts.append(("run", run.encode()))
            parts.append(("tail" if m.start() < spaces else "contraction" if re.fullmatch("'(re|ve|ll)", word) else "word", word.encode()))
        return parts

    def make(self, found: list[bytes]) -> list[np.ndarray]:
        """Counts of all prefixes of each piece, for ``PieceTable``."""
        plans, wanted = [], {}

        def want(word: bytes) -> int:
            return wanted.setdefault(word, len(wanted))

        for raw in found:
            text = raw.decode("utf-8", "replace")
            if m := self.vocabulary.plain.fullmatch(text):
                plans.append([[("word", want(w.encode())) for w in m.groups() if w], None])
                continue
            segments, at_ = [], 0
            for m in self.special_split.finditer(text) if self.special_split else ():
                segments.append((text[at_ : m.start()], m.group()))
                at_ = m.end()
            segments.append((text[at_:], ""))
            plans.append([None, [([(k, want(w)) for k, w in self.piece_parts(s)], [(k, want(w)) for k, w in self.piece_parts(s + special[:-1])], len((s + special).encode()), special) for s, special in segments]])
        want(b"'")
        for letter in b"rvl":
            want(bytes([letter]))
        names = list(wanted)
        solved = self.words(names)
        out = []
        for raw, (plain, segments) in zip(found, plans):
            if plain is not None:
                counts = self._joined(plain, names, solved, wanted)
            else:
                values, base = [], 0
                for own, longer, size, special in segments:
                    whole = self._joined(own, names, solved, wanted)
                    if special:
                        values.append(np.append(self._joined(longer, names, solved, wanted), (whole[-1] if len(whole) else 0) + 1) + base)
                        base = int(values[-1][-1])
                    else:
                        values.append(whole + base)
                counts = np.concatenate(values)
            inner = np.flatnonzero((np.frombuffer(raw, np.uint8)[1:] & 0xC0) == 0x80)  # prefixes that end inside a character
            for i in inner.tolist() if len(inner) else ():
                counts[i] = counts[i - 1] if i else 0
            out.append(counts)
        return out

    def _joined(self, parts, names, solved, wanted) -> np.ndarray:
        out, base, shown = [], 0, 0
        for kind, k in parts:
            counts = solved[k]
            if kind == "run":  # a prefix that ends in white space has the whole run so far as one word
                out.append(base + counts)
                shown = len(counts)
                continue
            if kind == "tail":
                skipped = min(shown, len(counts))
                shown -= skipped
                out.append(base + counts[skipped:])
            elif kind == "contraction":
                counts = counts.copy()
                counts[1] = solved[wanted[b"'"]][0] + solved[wanted[names[k][1:2]]][0]
                out.append(base + counts)
                counts = solved[k]
            else:
                out.append(base + counts)
            base += int(counts[-1])
        return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


@functools.lru_cache(maxsize=2)
def prefix_table(path: str) -> PieceTable:
    """One table a process and vocabulary file, kept from task to task."""
    return PieceTable(PrefixCounter(path).make, keep_space=True)


def totals(table: PieceTable, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and entries of all pieces, the tokens before each (and after the last), and the places where texts begin."""
    starts, ends = pieces(buf, offsets, True)
    entries = table.look_up(buf, starts, ends)
    whole = table.flat[table.at[entries] + table.count[entries] - 1].astype(np.int64)
    return starts, entries, np.concatenate([[0], np.cumsum(whole)]), np.searchsorted(starts, offsets)


def counted(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) and fit_bytes, the longest
    prefix of at most ``limit`` tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for batch in batches:
            texts, keys = at.text_column(batch.column(1)), batch.column(0)
            for a, b in at.slices(texts):
                buf, offsets = at.buffer_of(texts.slice(a, b - a))
                starts, entries, before, edges = totals(table, buf, offsets)
                size, n = np.diff(offsets), before[edges[1:]] - before[edges[:-1]]
                fit = size.copy()
                for i in np.flatnonzero(n > limit).tolist():
                    lo, hi = edges[i], edges[i + 1]
                    # The last piece that begins within the limit may still end in it; no later one can.
                    k = lo + int(np.searchsorted(before[lo:hi] - before[lo], limit, "right")) - 1
                    fit[i] = starts[k] - offsets[i]
                    while k >= lo:
                        own = before[k] - before[lo] + table.flat[table.at[entries[k]] : table.at[entries[k]] + table.count[entries[k]]]
                        if len(good := np.flatnonzero(own <= limit)):
                            fit[i] = starts[k] - offsets[i] + good[-1] + 1
                            break
                        k -= 1
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def with_prefixes(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``prefixes``: the counts of the text's prefixes of 1, 2, ... bytes, as little-endian 32-bit integers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(path)
        for batch in batches:
            texts, keys = at.text_column(batch.column(1)), batch.column(0)
            for a, b in at.slices(texts):
                buf, offsets = at.buffer_of(texts.slice(a, b - a))
                starts, entries, before, edges = totals(table, buf, offsets)
                sizes = table.count[entries]
                text = np.repeat(np.arange(b - a), np.diff(edges))
                base = np.repeat(before[:-1] - before[edges[text]], sizes)
                values = (table.flat[at.ragged_index(table.at[entries], sizes)] + base).astype("<i4")
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), at.binary_array(values, offsets - offsets[0])], ["doc_id", "prefixes"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(count, "doc_id long, prefixes binary")
