"""Distinct word-shingle sets of a batch of texts, as sorted 64-bit hashes, by numpy over the whole batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240607)
#: Random 64-bit values of bytes (A-Z have those of a-z), multipliers of a shingle's words, and the base of positions.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_WORD = _RNG.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, np.uint64)
#: Bytes that are hashed at a time.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(n, _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def _inverse(x: int) -> np.uint64:
    return np.uint64(pow(int(x), -1, 1 << 64))


_UNBASE_POWERS = np.ones(1, np.uint64)


def _unpowers(n: int) -> np.ndarray:
    global _UNBASE_POWERS
    if len(_UNBASE_POWERS) < n:
        p = np.full(n, _inverse(_BASE), np.uint64)
        p[0] = 1
        _UNBASE_POWERS = np.multiply.accumulate(p)
    return _UNBASE_POWERS[:n]


def word_blocks(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, start byte, end byte) of each maximal run of non-white bytes, ``BLOCK`` bytes at a time; runs end where a text ends.

    A run that goes on into the next block is carried: its hash so far, its length and its start.
    """
    so_far, length, begun = np.uint64(0), 0, -1
    for a in range(0, len(raw), BLOCK):
        r = raw[a : a + BLOCK]
        n = len(r)
        white = _WHITE[r]
        edge = np.zeros(n + 1, bool)
        x, y = np.searchsorted(off, (a, a + n + 1))
        edge[off[x:y] - a] = True
        near = np.empty(n, bool)
        near[0], near[1:] = not a or _WHITE[raw[a - 1]], white[:-1]
        start = np.flatnonzero(~white & (near | edge[:-1]))
        near[-1], near[:-1] = a + n == len(raw) or _WHITE[raw[a + n]], white[1:]
        end = np.flatnonzero(~white & (near | edge[1:])) + 1
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[r] * _powers(n), out=total[1:])
        first = []
        if begun >= 0:
            at = int(end[0]) if len(end) else n
            so_far = so_far + total[at : at + 1] * np.uint64(pow(int(_BASE), length, 1 << 64))
            length += at
            if not len(end):
                continue
            first, end = [(so_far + np.uint64(length) * _WORD[15 : 16], begun, a + at)], end[1:]
            begun = -1
        if len(start) > len(end):
            at = int(start[-1])
            so_far, length, begun = (total[n:] - total[at : at + 1]) * _unpowers(n)[at], n - at, a + at
            start = start[:-1]
        h = (total[end] - total[start]) * _unpowers(n)[start] + (end - start).astype(np.uint64) * _WORD[15]
        start, end = start + a, end + a
        for g, s, e in first:
            h, start, end = np.concatenate((g, h)), np.append(s, start), np.append(e, end)
        yield mix(h), start, end


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each maximal run of non-white bytes; runs end where a text ends."""
    blocks = list(word_blocks(raw, off))
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*blocks))


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, one after the other; offsets). Fewer words than ``width``: one shingle."""
    hashes, first = [np.empty(0, np.uint64)], np.zeros(len(off), np.int64)
    for h, start, _ in word_blocks(raw, off):
        hashes.append(h)
        first += np.searchsorted(start, off)
    h = np.concatenate(hashes)
    del hashes
    n = np.diff(first)
    whole = h * _WORD[0]
    for j in range(1, width):
        whole[: max(len(h) - j, 0)] += h[j:] * _WORD[j]
    whole = mix(whole)
    sets = []
    for a, b, k in zip(first[:-1].tolist(), first[1:].tolist(), n.tolist()):
        if k >= width:
            s = whole[a : b - width + 1]
            s.sort()
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s)
        elif k:
            sets.append(mix((h[a:b] * _WORD[:k]).sum(keepdims=True) + np.uint64(k)))
        else:
            sets.append(h[:0])
    size = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else h[:0]), np.concatenate(([0], np.cumsum(size)))
