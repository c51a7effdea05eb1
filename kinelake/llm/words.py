"""Words of whole texts as numpy arrays: bounds, hashes and rolling window hashes.

Arrow string columns are read as one run of UTF-8 bytes. A word is a maximal run of word bytes inside
one text; bytes of 0x80 and above always belong to words, so no character is ever cut. Hashes are
polynomial (Rabin-Karp) modulo 2**64 over at most ``SHORT`` terms; what is longer is hashed by BLAKE2b,
because polynomials modulo a power of two collide on long patterned texts whatever the base. All arrays
beside the text are made for a bounded run of words at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about this many bytes, so that the arrays of a piece stay small.
PIECE_BYTES = 2_000_000

#: Words of more bytes, and sequences of more words, are hashed by BLAKE2b. Words hashed at once.
SHORT, WORDS_AT_ONCE = 64, 1 << 17

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that any bits of a hash may serve as a bucket."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse for i below n."""
    out = ()
    for b in (base, pow(base, -1, 1 << 64)):
        run = np.full(n, b, np.uint64)
        run[:1] = 1
        out += (np.cumprod(run, dtype=np.uint64),)
    return out


def long_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


@dataclass(frozen=True)
class Alphabet:
    """Which bytes make words, and what each counts as in a hash."""

    is_word: np.ndarray
    values: np.ndarray
    fold: np.ndarray


@lru_cache(maxsize=None)
def alphabet(alnum: bool = False, lower: bool = False) -> Alphabet:
    """alnum: ASCII letters and digits only (and all of 0x80 up), else all but ASCII white space."""
    code = np.arange(256)
    if alnum:
        word = (code >= 0x80) | ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    else:
        word = ~((code == 0x20) | ((code >= 9) & (code <= 13)))
    values = mix(code.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    fold = code.astype(np.uint8)
    if lower:
        values[65:91], fold[65:91] = values[97:123], fold[97:123]
    return Alphabet(word, values, fold)


@dataclass
class Words:
    """Words of some texts, in order. ``first[d]`` is the number of words before text d."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the bounds of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), at - at[0] if len(at) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``size`` bytes: first text, end, bytes, bounds."""
    data, at = text_bytes(column)
    begin, n = 0, len(at) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
        yield begin, end, data[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def word_bounds(word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, which never run over a text's bounds."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[at] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | fresh[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | fresh[1:n]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words_of(data: np.ndarray, at: np.ndarray, kind: Alphabet) -> Words:
    """Words of the texts ``data[at[d]:at[d + 1]]``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64), none.astype(np.uint64))
    starts, ends = word_bounds(kind.is_word[data], at)
    first = np.searchsorted(starts, at)
    return Words(data, starts, ends, first, span_hashes(data, starts, ends, kind))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: Alphabet) -> np.ndarray:
    """One hash for each of the spans of bytes."""
    out = np.zeros(len(starts), np.uint64)
    up = powers(BYTE_BASE, SHORT)[0]
    for i in range(0, len(starts), WORDS_AT_ONCE):
        a, n = starts[i : i + WORDS_AT_ONCE], ends[i : i + WORDS_AT_ONCE] - starts[i : i + WORDS_AT_ONCE]
        short = (n <= SHORT) & (n > 0)
        a, n = a[short], n[short]
        if len(a):
            offset = spans(n)
            terms = kind.values[data[np.repeat(a, n) + offset]] * up[offset]
            out[i : i + WORDS_AT_ONCE][short] = np.add.reduceat(terms, np.cumsum(n) - n)
    for i in np.flatnonzero(ends - starts > SHORT):
        out[i] = long_hash(kind.fold[data[starts[i] : ends[i]]].tobytes())
    return mix(out)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n consecutive words of one text, and the place of each one's first word."""
    total = len(words.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.ones(total - n + 1, bool)
    edges = words.first[1:-1]
    for back in range(1, n):  # windows that would run over the end of a text
        over = edges - back
        inside[over[(over >= 0) & (over < len(inside))]] = False
    found = np.empty(len(inside), np.uint64)
    up, down = powers(WORD_BASE, WORDS_AT_ONCE + n)
    for i in range(0, len(inside), WORDS_AT_ONCE):
        part = words.hashes[i : i + WORDS_AT_ONCE + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        k = len(part) - n + 1
        found[i : i + k] = (sums[n:] - sums[:k]) * down[:k]
    place = np.flatnonzero(inside)
    return mix(found[place] + np.uint64(n)), place


def sequence_hashes(words: Words) -> np.ndarray:
    """One hash for the whole word sequence of each text."""
    a, b = words.first[:-1], words.first[1:]
    n = b - a
    out = np.zeros(len(a), np.uint64)
    short = (n <= SHORT) & (n > 0)
    if short.any():
        offset = spans(n[short])
        terms = words.hashes[np.repeat(a[short], n[short]) + offset] * powers(WORD_BASE, SHORT)[0][offset]
        out[short] = np.add.reduceat(terms, np.cumsum(n[short]) - n[short])
    for i in np.flatnonzero(n > SHORT):
        out[i] = long_hash(words.hashes[a[i] : b[i]].tobytes())
    return mix(out + n.astype(np.uint64))


def spans(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the runs of the given lengths."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))
