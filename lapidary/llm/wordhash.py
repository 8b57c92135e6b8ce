"""Words of a text as numpy arrays: places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import numpy as np

#: The blanks of the word rule ``[^\x20\x09-\x0D]+``.
IS_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_random = np.random.default_rng(64)
_OF_BYTE = np.where(IS_BLANK, 0, _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)).astype(np.uint64)
_OF_PLACE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def word_starts(data: np.ndarray) -> np.ndarray:
    """Places of first bytes of words in the UTF-8 bytes of a text."""
    blank = IS_BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    return np.flatnonzero(first)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word; blanks after a word add nothing to it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = starts[0]
    inside = np.arange(begin, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    sums = np.add.reduceat(_OF_BYTE[data[begin:]] * _OF_PLACE[inside & 255], starts - begin)
    sums ^= sums >> np.uint64(29)
    return sums * MIX[0]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` neighbouring words."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n, np.uint64)
    for i in range(width):
        sums = (sums ^ (sums >> np.uint64(31))) * MIX[1] + hashes[i : i + n] * MIX[2]
    return sums ^ (sums >> np.uint64(32))
