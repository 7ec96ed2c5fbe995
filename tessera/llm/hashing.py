"""Vectorised hashes of words and word shingles over whole batches of UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i below *n* at least."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", _INVERSE)):
            x = np.full(n, U(base))
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, lower-cased in ASCII; first word of each document, one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    letter = ~_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = letter[inner]
    ends[inner - 1] = letter[inner - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(_BYTE_LOWER[data] * up[:n], out=total[1:])
    h = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(U))
    return h, np.searchsorted(start, off)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted in each document; first of each document).

    A document of fewer words than *width*, but not none, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    rolled = np.zeros(len(h), U)
    if len(h) >= width:
        acc = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            acc *= U(0xD6E8FEB86659FD93)
            acc += h[k : len(h) - width + 1 + k]
        rolled[: len(acc)] = mix(acc)
    out: list[np.ndarray] = []
    for a, k in zip(first[:-1].tolist(), n.tolist()):
        if k >= width:
            out.append(np.unique(rolled[a : a + k - width + 1]))
        elif k:
            s = k
            for x in h[a : a + k].tolist():
                s = (s * 0xA24BAED4963EE407 + x + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([s], U)))
        else:
            out.append(np.zeros(0, U))
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)
