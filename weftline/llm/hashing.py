"""Words, word hashes and shingles of Arrow text columns, in numpy.

Every function works on the UTF-8 bytes of many texts at once, in blocks of a
bounded number of bytes, whatever the length of a text or a word.  A word's hash
is a polynomial over 64-bit values drawn for each byte, finished by a mixer, so
equal words have equal hashes and different ones collide about once in 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 on 64-bit values (fixed constants)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, powers of its inverse, one value per byte."""
    step = np.full(BLOCK + 1, _BASE, dtype=U)
    back = np.full(BLOCK + 1, pow(_BASE, -1, 1 << 64), dtype=U)
    step[0] = back[0] = 1
    values = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    return np.cumprod(step, dtype=U), np.cumprod(back, dtype=U), values


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


FOLD = _fold()

#: Every byte as it is.
AS_IS = np.arange(256, dtype=np.uint8)

#: Bytes of words: everything but blanks (0x20, 0x09-0x0D).
BLANK_SEPARATED = np.ones(256, dtype=bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words: digits, letters (already in lower case) and all beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, where


def _spans(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true values; a run is cut where ``first`` says so."""
    cut = np.zeros(len(word) + 1, dtype=bool)
    cut[first] = True
    cut[-1] = True
    before = np.empty(len(word), dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(len(word), dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    begins = np.flatnonzero(word & (~before | cut[:-1]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return begins, ends


def _raw(folded: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, back, values = _tables()
    total = np.zeros(len(folded) + 1, dtype=U)
    np.cumsum(values[folded] * power[: len(folded)], out=total[1:])
    return (total[ends] - total[begins]) * back[begins]


def _long_text(data: np.ndarray, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, begins and ends of the words of one text, block by block."""
    hashes, all_begins, all_ends = [], [], []
    open_hash, open_begin, open_len = 0, 0, 0
    for at in range(0, len(data), BLOCK):
        folded = fold[data[at : at + BLOCK]]
        word = is_word[folded]
        begins, ends = _spans(word, np.zeros(1, dtype=np.int64))
        raw, begins_at = _raw(folded, begins, ends), begins + at
        if open_len and word[0]:
            raw[0] = U((open_hash + int(raw[0]) * pow(_BASE, open_len, 1 << 64)) & _MASK)
            begins_at[0] = open_begin
        elif open_len:
            hashes.append(np.array([open_hash], dtype=U))
            all_begins.append(np.array([open_begin]))
            all_ends.append(np.array([open_begin + open_len]))
        open_len = 0
        if word[-1]:
            open_hash, open_begin = int(raw[-1]), int(begins_at[-1])
            open_len = int(ends[-1]) + at - open_begin
            raw, begins_at, ends = raw[:-1], begins_at[:-1], ends[:-1]
        hashes.append(raw)
        all_begins.append(begins_at)
        all_ends.append(ends + at)
    if open_len:
        hashes.append(np.array([open_hash], dtype=U))
        all_begins.append(np.array([open_begin]))
        all_ends.append(np.array([open_begin + open_len]))
    return mix(np.concatenate(hashes)), np.concatenate(all_begins), np.concatenate(all_ends)


def word_blocks(
    column: pa.Array, is_word: np.ndarray, fold: np.ndarray = FOLD
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of the texts, for a bounded number of bytes at a time.

    Yields (first, counts, hashes, begins, ends, data): ``first`` is the index of
    the first text of the block, ``counts`` the number of words of each of its
    texts, the rest is per word, with byte positions into ``data``.  ``fold`` maps
    the bytes before they are hashed: A-Z to lower case, if not given.
    """
    data, where = text_bytes(column)
    n, i = len(where) - 1, 0
    while i < n:
        if where[i + 1] - where[i] > BLOCK:
            text = data[where[i] : where[i + 1]]
            hashes, begins, ends = _long_text(text, is_word, fold)
            yield i, np.array([len(hashes)]), hashes, begins, ends, text
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(where, where[i] + BLOCK, side="right")) - 1)
        j = min(j, n)
        text = data[where[i] : where[j]]
        edges = where[i : j + 1] - where[i]
        if len(text):
            folded = fold[text]
            begins, ends = _spans(is_word[folded], edges[:-1])
            hashes = mix(_raw(folded, begins, ends))
            counts = np.diff(np.searchsorted(begins, edges))
        else:
            begins = ends = np.zeros(0, dtype=np.int64)
            hashes, counts = np.zeros(0, dtype=U), np.zeros(j - i, dtype=np.int64)
        yield i, counts, hashes, begins, ends, text
        i = j


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """One hash per run of ``size`` words; a shorter text is one run; none, none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1] + U(size)
    for k in range(1, size):
        out = mix(out * U(0x9FB21C651E98DF25) + words[k : len(words) - size + 1 + k])
    return out


def distinct_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return np.unique(shingles(words, size))
