"""Word shingles of Arrow text columns as 64-bit hashes, by array arithmetic.

A-Z is lower-cased, words are maximal runs of bytes other than space and
\\x09-\\x0D, a shingle is the hash of ``width`` words in a row. A text with fewer
words has one shingle, its whole sequence; one without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_SEED = 0x5EED
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(data: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of data[start:end] from running sums, scrambled."""
    rng = np.random.default_rng(_SEED)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    upper = np.arange(65, 91)
    values[upper] = values[upper + 32]
    base = int(rng.integers(1, 1 << 62)) * 2 + 1
    inverse = pow(base, -1, 1 << 64)
    powers = np.full(len(data) + 1, base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers[:-1], out=sums[1:])
    back = np.full(len(data) + 1, inverse, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * back[starts] + lengths * _U(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array, width: int = WIDTH, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; no nulls. Works on about
    ``limit`` bytes at a time; a longer text is worked on alone."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if len(texts) == 0:
        return
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield from _group(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
        lo = hi


def _group(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    word = ~space
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], space[:-1])))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((space[1:], [True])))) + 1 if len(data) else starts
    hashes = _word_hashes(data, space, starts, ends)
    first = np.searchsorted(starts, offsets)  # first word of each text
    factor = _U(0xD6E8FEB86659FD93)
    grams = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        grams = grams * factor + hashes[k : k + len(grams)]
    grams = mixed(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                whole = whole * factor + h
            yield mixed(whole + _U(b - a))
        else:
            yield np.zeros(0, np.uint64)
