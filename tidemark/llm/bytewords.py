"""Words, and hashes of stretches, of many UTF-8 texts at once.

A stretch's hash is a polynomial in a table value per byte, modulo 2**64, taken
from prefix sums, so every stretch of a slab costs two look-ups. Multiplying by
the inverse power makes it independent of the place.
"""

from __future__ import annotations

import functools

import numpy as np

from tidemark.llm.common import mixed

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3


@functools.lru_cache(maxsize=None)
def byte_values(fold: bool) -> np.ndarray:
    """A 64-bit value per byte; with fold, ASCII capitals have their small letters' values."""
    v = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if fold:
        v[65:91] = v[97:123]
    return v


@functools.lru_cache(maxsize=None)
def byte_kinds(coarse: bool) -> np.ndarray:
    """BLANK, LETTER, DIGIT or OTHER per byte; coarse knows BLANK and LETTER only. Bytes beyond ASCII are letters."""
    k = np.full(256, LETTER if coarse else OTHER, np.uint8)
    if not coarse:
        k[48:58], k[65:91], k[97:123], k[128:] = DIGIT, LETTER, LETTER, LETTER
    k[[32, *range(9, 14)]] = BLANK
    return k


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n; kept for later calls."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", _INVERSE)):
            p = np.full(n + n // 8, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, from 0 on."""
    up, _ = powers(len(values) + 1)
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=p[1:])
    return p


def stretches(p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [first, last)."""
    _, down = powers(len(p))
    return (p[last] - p[first]) * down[first]


def words(data: np.ndarray, ends: np.ndarray, coarse: bool = True, fold: bool = False):
    """first, last, doc, hash and kind of each maximal run of one kind that isn't blank.

    coarse: the words of the contracts. Otherwise letters, digits and others are runs of their own.
    """
    kind = byte_kinds(coarse)[data]
    if not len(kind):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[ends] = True
    cuts = np.flatnonzero(edge)
    first, last = cuts[:-1], cuts[1:]
    held = kind[first] != BLANK
    first, last = first[held], last[held]
    doc = np.searchsorted(ends, first, "right") - 1
    h = mixed(stretches(prefix(byte_values(fold)[data]), first, last))
    return first, last, doc, h, kind[first]


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of n words within one document; h are word hashes, doc their documents."""
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
    p = prefix(h)
    return at, mixed(stretches(p, at, at + n))
