"""Token ids of a column of texts, by a vocabulary file of the tokenizers library.

A text is cut where the tokenizer always cuts it: before white space that follows other characters. What lies between
is encoded once and kept in a table of fixed size, so a frequent word costs a look-up. Entries are found by their first
and last eight bytes and their length, which is the whole content of a piece of up to 16 bytes; longer pieces are kept
by content. The ids are those of ``Tokenizer.encode`` over the whole text, special strings inside texts included.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

from exposure.llm.arrow_text import SPACES, forgetting, mix64, ragged_index, words_view

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TABLE_BITS = 20
KEPT_VALUES = 24_000_000
KEPT_LONG = 200_000
#: Lead bytes of the white-space characters beyond ASCII in UTF-8.
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xE1, 0xE2, 0xE3]] = True


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)]


def pieces(buf: np.ndarray, offsets: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all texts. With ``keep_space`` they cover the texts, each white-space run going
    to what follows it; without, they are the runs between white space."""
    space = SPACES[buf]
    inside = np.zeros(len(buf), bool)
    inside[offsets[0] : offsets[-1]] = True
    begins = np.zeros(len(buf) + 1, bool)
    begins[offsets] = True
    if not keep_space:
        solid = inside & ~space
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        return np.flatnonzero(solid & (~before | begins[:-1])), np.flatnonzero(solid & (~after | begins[1:])) + 1
    blurred = np.zeros(len(buf), bool)  # the byte may end a white-space character beyond ASCII
    high = buf >= 0x80
    blurred[1:] |= high[1:] & (buf[:-1] == 0xC2)
    blurred[2:] |= high[2:] & _WIDE_SPACE[buf[:-2]]
    cut = np.zeros(len(buf), bool)
    cut[1:] = space[1:] & ~space[:-1] & ~blurred[:-1]
    starts = np.flatnonzero(inside & (cut | begins[:-1]))
    return starts, np.append(starts[1:], offsets[-1]) if len(starts) else starts


class PieceTable:
    """Values of pieces, made by ``make(list of bytes) -> list of integer sequences`` when a piece is new."""

    def __init__(self, make, keep_space: bool, bits: int = TABLE_BITS):
        self.make, self.keep_space, self.bits = make, keep_space, bits
        self._clear()

    def _clear(self) -> None:
        size = 1 << self.bits
        self.first, self.last = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.length, self.entry = np.full(size, -1, np.int32), np.zeros(size, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.count, self.entries = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.long: dict[bytes, int] = {}

    def _store(self, values: list) -> np.ndarray:
        counts = np.fromiter(map(len, values), np.int64, len(values))
        need, n = self.used + int(counts.sum()), self.entries + len(values)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.at):
            self.at, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.at, self.count))
        self.flat[self.used : need] = np.fromiter((x for v in values for x in v), np.int32, int(counts.sum()))
        self.at[self.entries : n], self.count[self.entries : n] = self.used + np.cumsum(counts) - counts, counts
        out = np.arange(self.entries, n)
        self.used, self.entries = need, n
        return out

    def look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of every piece. Entries hold until the next call."""
        if self.used > KEPT_VALUES or len(self.long) > KEPT_LONG:
            self._clear()
        out = np.zeros(len(starts), np.int64)
        lengths = ends - starts
        wide = np.flatnonzero(lengths > 16)
        keys = [buf[s:e].tobytes() for s, e in zip(starts[wide].tolist(), ends[wide].tolist())]
        if new := list({k for k in keys if k not in self.long}):
            self.long.update(zip(new, self._store(self.make(new)).tolist()))
        out[wide] = [self.long[k] for k in keys]
        todo = np.flatnonzero(lengths <= 16)
        view, size = words_view(buf), lengths[todo]
        first, last = view[starts[todo]], view[ends[todo] - 8]
        mask = np.where(size < 8, (np.uint64(1) << (np.minimum(size, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1), ~np.uint64(0))
        first = first & mask
        last = np.where(size > 8, last, np.uint64(0))
        slot = (mix64(first + mix64(last + size.astype(np.uint64))) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            hit = (self.first[slot] == first) & (self.last[slot] == last) & (self.length[slot] == size)
            out[todo[hit]] = self.entry[slot[hit]]
            todo, slot, first, last, size = (a[~hit] for a in (todo, slot, first, last, size))
            if not len(todo):
                break
            taken, at = np.unique(slot, return_index=True)
            made = self._store(self.make([buf[s:e].tobytes() for s, e in zip(starts[todo[at]].tolist(), ends[todo[at]].tolist())]))
            self.first[taken], self.last[taken], self.length[taken], self.entry[taken] = first[at], last[at], size[at], made
        return out

    def values(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of all texts, one after another, and the n + 1 offsets of the texts in them."""
        starts, ends = pieces(buf, offsets, self.keep_space)
        entries = self.look_up(buf, starts, ends)
        counts = self.count[entries]
        edges = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[ragged_index(self.at[entries], counts)], edges[np.searchsorted(starts, offsets)]


class Vocabulary:
    """A vocabulary file, and the ids of single pieces by it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.word_ends = bool(self.spec["model"].get("end_of_word_suffix"))
        self.symbols = byte_symbols()
        self.special = [t["content"] for t in self.spec["added_tokens"]]
        # Pieces of these shapes are one or two words to the model; all others take the whole tokenizer.
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        self.plain = re.compile(rf"([{letters}]+)([^\sA-Za-z0-9'\x80-\U0010ffff<]*)" if self.word_ends else rf"( ?[{letters}]+)([^\sA-Za-z0-9'\x80-\U0010ffff<]*)")
        self.table = str.maketrans({chr(b): s for b, s in enumerate(self.symbols)})

    def _word(self, word: str) -> list[int]:
        mapped = word.encode().decode("latin-1").translate(self.table)
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def encode(self, found: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        out = []
        for raw in found:
            text = raw.decode("utf-8", "replace")
            if m := self.plain.fullmatch(text):
                word, mark = m.groups()
                out.append(self._word(word.lower() if self.word_ends else word) + (self._word(mark) if mark else []))
            else:
                out.append(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def id_table(path: str) -> PieceTable:
    """One table a process and vocabulary file, kept from task to task."""
    v = vocabulary(path)
    return PieceTable(v.encode, keep_space=not v.word_ends)


forgetting += [id_table.cache_clear, vocabulary.cache_clear]
