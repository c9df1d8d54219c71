"""Words and word shingles of many texts at once, as arrays of 64-bit hashes.

Works on the UTF-8 bytes of an Arrow column.  A word is a run of bytes other than space and
\\t \\n \\v \\f \\r; A-Z count as a-z.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at once.
BLOCK = 1 << 18
WIDTH = 5  # words in a shingle

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = [np.uint64(pow(_BASE, 2 * k + 3, 1 << 64) | 1) for k in range(WIDTH)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ...; at least n of them."""
    if base not in _powers or len(_powers[base]) < n:
        x = np.full(max(n, BLOCK + 4096), base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of consecutive texts."""

    data: np.ndarray  # bytes
    texts: np.ndarray  # first byte of each text, and the end of the last
    start: np.ndarray  # first byte of each word
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each text begins, and the end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, texts: np.ndarray) -> Words:
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[texts] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # whole words, about a BLOCK of bytes at once
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        a, b = start[i], end[j - 1]
        n = int(b - a)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_FOLD[data[a:b]] * _power(_BASE, n), out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        hashes[i:j] = mix((sums[e] - sums[s]) * _power(_INVERSE, n)[s])
        i = j
    first = np.searchsorted(start, texts)
    return Words(data, texts, start, end, hashes, first)


def chunks(column: pa.Array, most: int = 2 * BLOCK) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of runs of rows with about ``most`` bytes, or one longer text."""
    data, texts = flat(column)
    i, n = 0, len(texts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(texts, texts[i] + most, "right")) - 1)
        yield i, j, words(data[texts[i] : texts[j]], texts[i : j + 1] - texts[i])
        i = j


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle, repeated ones included, in order of place.

    A text with fewer than WIDTH words, but one, has a single shingle of all its words.
    """
    text = np.repeat(np.arange(len(w.first) - 1), w.counts)
    n = len(w.hash)
    m = max(0, n - WIDTH + 1)
    total = np.zeros(m, np.uint64)
    for k in range(WIDTH):
        total += w.hash[k : k + m] * _STEP[k]
    whole = text[:m] == text[n - m :] if m else np.zeros(0, bool)
    keys, owner = mix(total[whole], WIDTH), text[:m][whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < WIDTH))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for k in range(WIDTH - 1):
            has = w.counts[short] > k
            more[has] += w.hash[w.first[short[has]] + k] * _STEP[k]
        keys = np.concatenate([keys, mix(more, 1) ^ w.counts[short].astype(np.uint64)])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
    return owner, keys


def distinct(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, key) pairs, ordered by owner and key."""
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    return o[new], k[new]
