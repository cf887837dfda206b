"""Vectorised word hashing straight from Arrow string buffers.

A word is a maximal run of ASCII letters, digits and any non-ASCII character;
everything else separates. ASCII letters are folded here; callers lower-case other
scripts in the JVM with ``F.lower`` before the text crosses to Python. Nothing is
decoded to Python strings, so the cost is a handful of numpy passes over the bytes.

The 64-bit hash of a word is ``sum((byte + 1) * B**k)`` over its bytes, modulo 2**64,
then mixed. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are hashed in runs of about this many bytes, so that the arrays stay in cache.
CHUNK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

#: Powers are kept for so many bytes at most; longer runs, which single words of that length make, compute their own.
KEPT_POWERS = 4 * CHUNK_BYTES

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below n, grown by doubling and kept per process up to KEPT_POWERS."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=_U)
    while len(have) < n:
        step = _U(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    _powers[base] = have[:KEPT_POWERS]
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    folded = _FOLD[data]
    inside = np.zeros(n + 1, dtype=bool)
    inside[:n] = _WORD[folded]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge))
    end = np.flatnonzero(before & (~inside | edge))
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((folded.astype(_U) + _U(1)) * _power(BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _power(INVERSE, n + 1)[start]
    return mix(h), np.searchsorted(start, at), start, end


def chunks(at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about `size` bytes; a longer text is a run by itself."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _long_words(data: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_words of one long text, a piece of about `size` bytes at a time, cut where no word is."""
    parts, low = [], 0
    while low < len(data):
        high = low + size
        while high < len(data):
            gap = np.flatnonzero(~_WORD[_FOLD[data[high : high + size]]])
            high += int(gap[0]) if len(gap) else size
            if len(gap):
                break
        high = min(high, len(data))
        h, _, start, end = _words(data[low:high], np.array([0, high - low]))
        parts.append((h, start + low, end + low))
        low = high
    h, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, np.array([0, len(h)]), start, end


def word_runs(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts [i, j): (i, j, word hashes, j - i + 1 word offsets, byte starts, byte ends).

    Starts and ends count from the first byte of text i.
    """
    data, at = text_bytes(column)
    for i, j in chunks(at, size):
        part = data[at[i] : at[j]]
        yield (i, j, *(_long_words(part, size) if j == i + 1 and len(part) > 2 * size else _words(part, at[i : j + 1] - at[i])))


def gram_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word grams of each text and their offsets, in order of position.

    A text of fewer than n words has one gram, all of its words; one of none has no gram.
    """
    counts = np.diff(offsets)
    full = np.maximum(counts - n + 1, 0)
    grams = np.where(counts > 0, np.maximum(full, 1), 0)
    out = np.zeros(len(grams) + 1, dtype=np.int64)
    np.cumsum(grams, out=out[1:])
    first = np.repeat(offsets[:-1] - out[:-1], grams) + np.arange(out[-1])
    last = np.minimum(first + n, np.repeat(offsets[1:], grams))
    # sums of word * BASE**place, cut into stretches so that powers stay few: a gram is a difference of sums within one
    h = np.zeros(len(first), dtype=_U)
    step = max(CHUNK_BYTES, 4 * n)
    for low in range(0, len(words), step):
        a, b = np.searchsorted(first, [low, low + step])
        if b > a:
            high = int(last[a:b].max())
            total = np.zeros(high - low + 1, dtype=_U)
            np.cumsum(words[low:high] * _power(BASE, high - low), out=total[1:])
            h[a:b] = (total[last[a:b] - low] - total[first[a:b] - low]) * _power(INVERSE, high - low)[first[a:b] - low] * _U(BASE)
    return mix(h), out


def distinct_grams(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct grams of each text, with offsets."""
    parts, sizes = [], np.zeros(len(offsets), dtype=np.int64)
    for k in range(len(offsets) - 1):
        part = np.unique(grams[offsets[k] : offsets[k + 1]])
        parts.append(part)
        sizes[k + 1] = len(part)
    return (np.concatenate(parts) if parts else grams[:0]), np.cumsum(sizes)
