"""Hashes of words and of word shingles, whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(2 * n, _BASE, np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the bytes, and where each begins; memory by slices."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) > len(starts):
        ends = ends[len(ends) - len(starts) :]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, "right")))
        sizes = ends[at:stop] - starts[at:stop]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        letters = raw[place + np.repeat(starts[at:stop], sizes)].astype(np.uint64) + np.uint64(1)
        out[at:stop] = np.add.reduceat(letters * _power(int(sizes.max()))[place], first)
        at = stop
    return mix(out), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of five words.

    Words are what ASCII white space divides, A-Z in lower case. Fewer than five words
    are one shingle; no words, none.
    """
    coded = [(text or "").encode().lower() for text in texts]
    words, starts = word_hashes(b"\n".join(coded))
    begins = np.cumsum([0, *(len(x) + 1 for x in coded)])
    bounds = np.searchsorted(starts, begins)
    weights = [np.uint64(m) for m in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA5A3564E27F8862B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    n = len(words) - SHINGLE + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k, weight in enumerate(weights):
        rolled += words[k : k + max(n, 0)] * weight
    rolled = mix(rolled)
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if j - i >= SHINGLE:
            out.append(np.unique(rolled[i : j - SHINGLE + 1]))
        elif j > i:
            total = np.array([j - i], np.uint64)
            for k in range(i, j):
                total = total * np.uint64(_BASE) + words[k]
            out.append(mix(total, salt=0x5A))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
