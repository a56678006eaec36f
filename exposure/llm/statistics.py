"""Figures that describe a text's form: what its bytes, words and lines look like, never which words they are.

All are ratios, logarithms or means, so that they hardly depend on length. A null or empty text has the figures of a text
without words: all zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from exposure.llm import arrow_text as at

NAMES = (
    "log_bytes", "log_words", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "wide", "ends", "line_words",
    "distinct_words", "repeated_triples", "repeated_lines", "capital_words", "bare_words", "marked_words", "shouted_words", "entropy", "space",
)

ROWS = 16_384  # texts of a slice at most: their bytes are counted in a table of 256 numbers a text

_UPPER, _DIGIT, _LETTER, _MARK, _SYMBOL, _END = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK[list(b".,;:!?'\"()-")] = True
_SYMBOL[list(b"#*$%&|<>@^~_=+\\/{}[]")] = True
_END[list(b".!?")] = True


def figures(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    out = np.zeros((len(texts), len(NAMES)))
    for a, b in at.slices(texts, 2 << 20):
        for c in range(a, b, ROWS):
            d = min(c + ROWS, b)
            out[c:d] = _slice(*at.buffer_of(texts.slice(c, d - c)))
    return out


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x / np.maximum(y, 1)


def _repeats(owner: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's keys equal an earlier one of the text."""
    pairs = at.mix64(keys + at.mix64(owner.astype(np.uint64) + np.uint64(1)))
    first = np.unique(pairs, return_index=True)[1]
    return np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)


def _slice(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    starts, ends, edges = at.word_spans(buf, offsets)
    words, owner = np.diff(edges), np.repeat(np.arange(n), np.diff(edges))
    length = ends - starts
    hashes = at.span_hashes(buf, starts, ends)
    per_word = lambda flags: np.bincount(owner, weights=flags, minlength=n)
    mean = _ratio(per_word(length), words)
    spread = np.sqrt(np.maximum(_ratio(per_word(length.astype(float) ** 2), words) - mean**2, 0))
    first, last = buf[starts], buf[np.maximum(ends - 1, 0)]
    upper = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_UPPER[buf], out=upper[1:])
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_LETTER[buf], out=letters[1:])
    uppers, letter = upper[ends] - upper[starts], letters[ends] - letters[starts]

    triple = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.zeros(0, np.int64)
    keys = at.mix64(hashes[triple] * np.uint64(3) + hashes[triple + 1] * np.uint64(5)) + hashes[triple + 2] if len(triple) else np.zeros(0, np.uint64)
    triples = np.bincount(owner[triple], minlength=n)

    feed = np.flatnonzero(buf == 10)
    feed = feed[(feed >= offsets[0]) & (feed < offsets[-1])]
    cuts = np.unique(np.concatenate([offsets[:-1][size > 0], feed + 1, offsets[-1:]]))
    line_start, line_end = cuts[:-1], cuts[1:] - (buf[cuts[1:] - 1] == 10)
    solid = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[solid], line_end[solid]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    line_keys = at.span_hashes(buf, line_start, line_end)
    lines = np.bincount(line_owner, minlength=n)

    byte = np.repeat(np.arange(n), size)
    counts = np.bincount(byte * 256 + buf[offsets[0] : offsets[-1]], minlength=n * 256).reshape(n, 256)
    share = _ratio(counts, size[:, None])
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    columns = (
        np.log1p(size), np.log1p(words), mean, spread, _ratio(count(_UPPER[buf]), size), _ratio(count(_DIGIT[buf]), size), _ratio(count(_MARK[buf]), size),
        _ratio(count(_SYMBOL[buf]), size), _ratio(count(buf >= 128), size), _ratio(count(_END[buf]), words), np.log1p(_ratio(words, lines)),
        1 - _ratio(_repeats(owner, hashes, n), words), _ratio(_repeats(owner[triple], keys, n), triples), _ratio(_repeats(line_owner, line_keys, n), lines),
        _ratio(per_word(_UPPER[first]), words), _ratio(per_word(letter == 0), words), _ratio(per_word(_SYMBOL[last] | (last == 33)), words), _ratio(per_word((uppers > 1) & (uppers == letter)), words),
        entropy, _ratio(count(at.SPACES[buf]), size),
    )
    return np.stack(columns, axis=1) * (words > 0)[:, None]
