"""Words of whole batches as 64-bit hashes, by vector operations on the UTF-8 bytes.

A word is a run of bytes other than space and the five controls from tab to carriage return; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * _C1
    h = h ^ (h >> np.uint64(27))
    h = h * _C2
    return h ^ (h >> np.uint64(31))


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; no word crosses from one text into the next."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def windows(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, zeros after the end; a view of a padded copy."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hash_runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty byte run, in blocks of bounded size.

    Eight bytes at a time are scrambled together with their place in the run before they are added up, so no
    pattern of letters cancels out as it can in a polynomial.
    """
    out = np.empty(len(begins), np.uint64)
    if not len(begins):
        return out
    eight = windows(_LOWER[data])
    sizes = ends - begins
    total = np.cumsum(sizes)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
        n = sizes[i:j]
        summed = mix((eight[begins[i:j]] & _TAIL[np.minimum(n, 8)]) + _PLACE)
        longer = np.flatnonzero(n > 8)
        if len(longer):
            steps = (n[longer] - 1) >> 3
            first = np.cumsum(steps) - steps
            step = np.arange(1, int(steps.sum()) + 1) - np.repeat(first, steps)
            left = np.minimum(np.repeat(n[longer], steps) - 8 * step, 8)
            values = eight[np.repeat(begins[i:j][longer], steps) + 8 * step] & _TAIL[left]
            summed[longer] += np.add.reduceat(mix(values + (step + 1).astype(np.uint64) * _PLACE), first)
        out[i:j] = mix(summed ^ n.astype(np.uint64))
        i = j
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the number of the text it stands in, in order."""
    begins, ends = word_bounds(data, starts)
    return hash_runs(data, begins, ends), np.searchsorted(starts, begins, side="right") - 1
