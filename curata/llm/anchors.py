"""Sampled suffixes of byte strings: every stretch of LENGTH bytes is served by one of them.

A start i is served by the anchor in i .. i + WINDOW - 1 whose K bytes have the
smallest hash (the leftmost of equals).  Equal stretches are served by anchors
at equal distances, and an anchor's CORE bytes lie in every stretch it serves.
"""

from __future__ import annotations

import numpy as np

LENGTH = 200
WINDOW = 128
CORE = LENGTH - WINDOW + 1
K = 16
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_PLACE = 24  # bits of a place in a block
BLOCK = 1 << 22


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ROOT), n, 1 << 64))


def _k_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the K bytes from each place on."""
    h, w = data.astype(np.uint64) + np.uint64(1), 1
    while w < K:
        h = h[:-w] * _power(w) + h[w:]
        w *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def serving(data: np.ndarray) -> np.ndarray:
    """The anchor that serves each start 0 .. len(data) - LENGTH of one block (shorter than 2**_PLACE)."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = _k_hashes(data)[: n + WINDOW - 1]
    low = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    w = 1
    while 2 * w <= WINDOW:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    if w < WINDOW:
        low = np.minimum(low[:n], low[WINDOW - w : WINDOW - w + n])
    return (low[:n] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts ``data[offsets[d]:offsets[d + 1]]``: document, place, first and last start served of each anchor.

    Places and starts count from the text's begin.  Starts of one text that an anchor serves are consecutive.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for d_from, d_to, a, z in _blocks(offsets):
        place = serving(data[a:z]) + a
        start = np.arange(a, a + len(place))
        doc = np.searchsorted(offsets[d_from : d_to + 1], start, side="right") - 1 + d_from
        inside = start + LENGTH <= offsets[doc + 1]
        place, start, doc = place[inside], start[inside], doc[inside]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place))[: len(first)] - 1
        base = offsets[doc[first]]
        out.append((doc[first], place[first] - base, start[first] - base, start[last] - base))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    doc, place, first, last = (np.concatenate(c) for c in zip(*out, strict=True))
    return doc, place, first, last


def _blocks(offsets: np.ndarray):
    """(first document, document after the last, byte from, byte to); a long text is cut in blocks that overlap."""
    d, n = 0, len(offsets) - 1
    while d < n:
        to = max(d + 1, int(np.searchsorted(offsets, offsets[d] + BLOCK, side="right")) - 1)
        a, z = int(offsets[d]), int(offsets[to])
        if to == d + 1 and z - a > BLOCK:
            for b in range(a, max(a + 1, z - LENGTH + 1), BLOCK):
                yield d, to, b, min(z, b + BLOCK + LENGTH - 1)
        else:
            yield d, to, a, z
        d = to
