"""Vectorised word tokens over Arrow string columns.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text; Latin-1
punctuation (U+0080-00BF), general punctuation (U+2000-206F) and CJK punctuation (U+3000-303F) separate words like ASCII
punctuation does. :data:`WORD` is the same rule as a regular expression, for SQL and for brute-force tests.

Words are carried as 64-bit hashes computed over the UTF-8 buffers with numpy, so no Python object exists per word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The rule as a class for RE2 and the ``regex``/``re`` modules, to be applied to lower-cased text.
WORD = "[0-9a-z_À-῿⁰-⿿぀-\U0010ffff]+"

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), ord("_")]] = True
_IS_WORD[0x80:] = True
_BLOCK = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of a column: ``doc[i]:doc[i+1]`` are the words of row i; start and end are bytes in the row's lower-cased text."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc) - 1), np.diff(self.doc))

    @property
    def index(self) -> np.ndarray:
        """Position of each word in its row."""
        return np.arange(len(self.hash)) - np.repeat(self.doc[:-1], np.diff(self.doc))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers whose bits all depend on all input bits."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)])) for p in (_P, inverse)]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return own, at - at[0]


def _mask(data: np.ndarray) -> np.ndarray:
    word = _IS_WORD[data]
    for lead, second, high in ((0xC2, None, 0), (0xE2, 0x80, 0xBF), (0xE2, 0x81, 0xAF), (0xE3, 0x80, 0xBF)):
        at = np.flatnonzero(data == lead)
        if second is None:
            word[at] = word[at + 1] = False
        else:
            at = at[(data[at + 1] == second) & (data[at + 2] <= high)] if len(at) else at
            word[at] = word[at + 1] = word[at + 2] = False
    return word


def words(column: pa.Array, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of a string column, whole texts; nulls and texts without words have none.

    With prefixes, hash has a row for the words and one for each number of bytes: the hash of the beginning of each word that is longer, else of the word.
    """
    data, rows = buffers(pc.utf8_lower(column.cast(pa.large_string()) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().cast(pa.large_string())))
    word = _mask(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    out = np.empty((1 + len(prefixes), len(start)), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(start):
            hi = max(lo + 1, int(np.searchsorted(start, start[lo] + _BLOCK)))
            a, b = start[lo], end[hi - 1]
            up, down = _power(int(b - a))
            total = np.empty(b - a + 1, np.uint64)
            total[0] = 0
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
            s, e = start[lo:hi] - a, end[lo:hi] - a
            for k, cut in enumerate((None, *prefixes)):
                to = e if cut is None else np.minimum(s + cut, e)
                out[k, lo:hi] = mix((total[to] - total[s]) * down[s] + (to - s).astype(np.uint64) + np.uint64(0 if cut is None else cut << 32) * (e - s > (cut or 0)))
            lo = hi
    doc = np.searchsorted(start, rows).astype(np.int64)
    base = np.repeat(rows[:-1], np.diff(doc))
    return Words(out if prefixes else out[0], doc, start - base, end - base)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row in order and the rows' offsets; a row with fewer than n words but at least one has one gram of all its words."""
    size = np.diff(w.doc)
    h = w.hash.copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            if len(h) > k:
                h[:-k] = mix(h[:-k] * np.uint64(3) + w.hash[k:])
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    pick = np.arange(at[-1]) + np.repeat(w.doc[:-1] - at[:-1], count)
    out = h[pick]
    with np.errstate(over="ignore"):
        for row in np.flatnonzero((size > 0) & (size < n)):
            own = w.hash[w.doc[row] : w.doc[row + 1]]
            x = own[:1].copy()
            for y in own[1:]:
                x = mix(x * np.uint64(3) + y)
            out[at[row]] = mix(x + np.uint64(size[row]))[0]
    return out, at
