"""Words of whole texts as hashes, straight from the UTF-8 buffers of a column.

A word is a run without ASCII white space, A-Z folded. No Python object is made per word: bytes are classed by
a table, and a word's hash is the sum of a random number per byte times one per place in the word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once: arrays that stay in the cache.
PIECE = 1 << 16
_RNG = np.random.default_rng(7)
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_PLACES, _FAR = (_RNG.integers(1, 2**62, PIECE, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def _places(at: np.ndarray) -> np.ndarray:
    if len(at) and int(at.max()) >= PIECE:
        return _PLACES[at % PIECE] * _FAR[at // PIECE % PIECE]
    return _PLACES[at]


def _piece(data: np.ndarray, starts: np.ndarray, carried: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first byte, sum) of every word of a piece, and the length of the word that it ends in, 0 if none.

    ``starts``: where texts begin; ``carried``: the length of the word that the piece before ended in. Its rest
    comes as a word that begins before the piece.
    """
    full = ~_BLANK[data]
    new = full.copy()
    new[1:] &= ~full[:-1]
    new[starts] = full[starts]
    if carried and full[0]:
        new[0] = True
    first = np.flatnonzero(new)
    if not len(first):
        return first, np.zeros(0, np.uint64), 0
    at = np.flatnonzero(full)
    begin = np.cumsum(full)[first] - 1
    length = np.diff(np.r_[begin, len(at)])
    open_ = carried if carried and full[0] else 0
    offset = first.copy()
    offset[0] -= open_
    sums = np.add.reduceat(_BYTES[data[at]] * _places(at - np.repeat(offset, length)), begin)
    tail = int(length[-1]) + (open_ if len(first) == 1 else 0) if full[-1] else 0
    if open_:
        first[0] = -1
    return first, sums, tail


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, where the words of every text begin in them) of the texts between ``bounds``."""
    lo, hi = int(bounds[0]), int(bounds[-1])
    firsts, sums, carried = [], [], 0
    for at in range(lo, hi, PIECE):
        part = data[at:min(at + PIECE, hi)]
        i, j = np.searchsorted(bounds, (at, at + len(part)))
        starts = np.unique(bounds[i:j]) - at
        first, total, tail = _piece(part, starts, 0 if len(starts) and starts[0] == 0 else carried)
        if len(first) and first[0] < 0:
            sums[-1][-1:] += total[:1]
            first, total = first[1:], total[1:]
        if len(first):
            firsts.append(first + at)
            sums.append(total)
        carried = tail
    if not firsts:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    h = np.concatenate(sums)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h, np.searchsorted(np.concatenate(firsts), bounds)


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(h) - width + 1), np.uint64(width))
    for k in range(width):
        out ^= h[k:len(h) - width + 1 + k]
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def shingle_sets(column: pa.Array, n: int, gather: int = 1 << 20) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``n``-word shingles; of its whole words where they are fewer."""
    data, bounds = buffers(column)
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + gather)))
        hi = min(hi, len(bounds) - 1)
        h, cut = word_hashes(data, bounds[lo:hi + 1])
        tokens = _mixed(h, n)
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if j - i >= n:
                t = np.sort(tokens[i:j - n + 1])
                yield t[np.r_[True, t[1:] != t[:-1]]]
            else:
                yield _mixed(h[i:j], j - i) if j > i else h[:0]
        lo = hi
