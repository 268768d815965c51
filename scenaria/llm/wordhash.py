"""Deterministic 64-bit hashes of words and word shingles for whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Multipliers of the splitmix64 finaliser (fixed values) and of the places in a shingle.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, and blank bytes: 0x20 and 0x09 to 0x0D.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
IS_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text (maximal runs without blanks), in order: sum over bytes of byte value times place value."""
    data = np.frombuffer(raw, np.uint8)
    inside = ~IS_BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = data[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    places = mix((np.arange(int(lengths.max())) + 1000).astype(np.uint64) * GOLDEN) | np.uint64(1)
    return mix(np.add.reduceat(BYTE_VALUES[letters] * places[place], first) + lengths.astype(np.uint64))


def shingles(raw: bytes, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter sequence is one shingle; none without words."""
    words = word_hashes(raw)
    if not len(words):
        return words
    width = min(size, len(words))
    whole = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        whole = mix(whole + words[i : len(words) - width + 1 + i]) * (GOLDEN + np.uint64(2 * i))
    return np.unique(mix(whole))


def set_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes."""
    total = mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total])).view(np.int64)[0])
