"""Operator 2: quality rules on repetition, from a suffix array of each text.

A suffix array of the characters is built by prefix doubling: suffixes are sorted by their
first 8 characters packed into one integer, then by pairs of ranks, and only suffixes still
tied are sorted again. The longest common prefix of a suffix and its neighbour in the array is one
less than that of the suffix before it in the text, unless the characters before the two differ;
so it is measured at those places only, whose prefixes sum to n log n at most, and follows
elsewhere: memory is a few integers a character however repetitive the text. A run of
neighbours whose LCP is at least min_repeat is an LCP interval; the maximal repeated substring of a
suffix is its greater LCP with a neighbour, and the union of the spans of all of them is the
part of the text that is repeated.

A text is rejected if that part is more than max_covered of it or if the longest repeat
exceeds max_repeat characters. It is row-local: one scan, no shuffle.

Defined results: a null or empty text has 0 characters, covered fraction 0 and is kept;
each input row gives one row, repeated rows too, and a null doc_id stays null; an empty table gives no
rows; other columns are ignored. Overlapping occurrences count, so that a run of one character is
its own repeat. Suffixes are never tied: a shorter one precedes. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import text_column, trim, trimmed

MIN_REPEAT = 40
MAX_COVERED = 0.5
MAX_REPEAT = 1000
_FIELDS = "doc_id long, n_chars long, covered_chars long, longest_repeat long, n_intervals long, keep boolean"


def _codes(text: str) -> np.ndarray:
    """The characters as small integers from 1, in order of code point."""
    try:
        raw = np.frombuffer(text.encode("latin-1"), np.uint8)
        if raw.size == 0 or raw.max() < 255:
            return raw + np.uint8(1)
    except UnicodeEncodeError:
        pass
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, codes = np.unique(points, return_inverse=True)
    return (codes + 1).astype(np.uint8 if len(distinct) < 255 else np.uint32)


def _packed(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """The first w characters at each position as one integer, and w; past the end is 0."""
    n = len(codes)
    width, bits = (8, 8) if codes.dtype == np.uint8 else (2, 32)
    padded = np.zeros(n + width, np.uint64)
    padded[:n] = codes
    key, have = padded, 1
    while have < width:
        ahead = np.zeros_like(key)
        ahead[: len(key) - have] = key[have:]
        key = (key << np.uint64(bits * have)) | ahead
        have *= 2
    return key[:n], width


def _neighbours(codes: np.ndarray, key: np.ndarray, width: int, order: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The longest common prefixes of the suffixes at places `near` of the array with the next ones."""
    n = len(codes)
    ahead = np.full(n, -1, order.dtype)  # the suffix before each in the array, where its LCP is asked for
    ahead[order[near + 1]] = order[near]
    left = np.flatnonzero(ahead >= 0)
    right = ahead[left]
    before = (left == 0) | (right == 0)
    before |= ahead[left - 1] < 0
    some = ~before
    before[some] = (ahead[left[some] - 1] != right[some] - 1) | (codes[left[some] - 1] != codes[right[some] - 1])
    start = np.flatnonzero(before)  # the others are one less than the one before
    length = np.zeros(len(start), np.int64)
    open_ = np.arange(len(start))
    i, j, done = left[start].astype(np.int64), right[start].astype(np.int64), 0
    while len(open_) > 64:
        a, b = i[open_] + done, j[open_] + done
        ok = np.maximum(a, b) < n
        ok[ok] = key[a[ok]] == key[b[ok]]
        stop = open_[~ok]
        length[stop] = done + _within(codes, i[stop] + done, j[stop] + done, width)
        open_, done = open_[ok], done + width
    for k in open_.tolist():
        length[k] = done + _common(codes, int(i[k]) + done, int(j[k]) + done)
    whole = np.full(n, -1, np.int64)
    whole[left[start]] = left[start] + length
    reach = np.maximum.accumulate(whole) - np.arange(n)
    return np.maximum(reach[order[near + 1]], 0)


def _within(codes: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """How many of the next `width` characters at a and b are equal, from the first."""
    n, out, same = len(codes), np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for k in range(width):
        ok = same & (np.maximum(a, b) + k < n)
        ok[ok] = codes[a[ok] + k] == codes[b[ok] + k]
        same = ok
        out += same
    return out


def _common(codes: np.ndarray, a: int, b: int) -> int:
    """The length of the common prefix of two suffixes, in steps that grow."""
    n, have, step = len(codes), 0, 256
    while True:
        size = min(step, n - max(a, b) - have)
        if size <= 0:
            return have
        differ = np.flatnonzero(codes[a + have : a + have + size] != codes[b + have : b + have + size])
        if len(differ):
            return have + int(differ[0])
        have, step = have + size, step * 2


def repetition(text: str, min_repeat: int = MIN_REPEAT) -> tuple[int, int, int, int]:
    """(characters, characters covered by repeats, longest repeat, LCP intervals) of a text."""
    codes = _codes(text)
    n = len(codes)
    if n <= min_repeat:
        return n, 0, 0, 0
    key, width = _packed(codes)
    order = np.argsort(key).astype(np.int32 if n < 1 << 31 else np.int64)
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=head[1:])
    tied_first = ~head
    rank = np.empty(n, order.dtype)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=order.dtype), 0))
    depth = width
    while True:
        follow = np.empty(n, bool)
        follow[:-1], follow[-1] = head[1:], True
        at = np.flatnonzero(~(head & follow))  # places in the array whose suffixes are still tied
        if not len(at):
            break
        tied = order[at]
        nxt = tied.astype(np.int64) + depth
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        pair = rank[tied].astype(np.int64) * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        order[at] = tied[by]
        pair = pair[by]
        head[at[1:]] |= pair[1:] != pair[:-1]
        # a tied run's ranks start at its first place
        first = np.maximum.accumulate(np.where(head, np.arange(n, dtype=order.dtype), 0))
        rank[order[at]] = first[at]
        depth *= 2
    # only neighbours that share the packed characters can reach min_repeat, unless it is less than those
    near = np.flatnonzero(tied_first[1:] | (min_repeat < width))
    lcp = _neighbours(codes, key, width, order, near)
    deep = lcp >= min_repeat
    if not deep.any():
        return n, 0, 0, 0
    near, lcp = near[deep], lcp[deep]
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, order[near], lcp)
    np.maximum.at(reach, order[near + 1], lcp)
    where = np.arange(n)
    covered = np.maximum.accumulate(np.where(reach > 0, where + reach, 0)) > where
    intervals = 1 + int(np.count_nonzero(np.diff(near) > 1))
    return n, int(covered.sum()), int(lcp.max()), intervals


def repetition_rules(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """(doc_id, n_chars, covered_chars, longest_repeat, n_intervals, keep) of each row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repetition(t or "", min_repeat) for t in batch.column(1).to_pylist()]
            n, covered, longest, intervals = np.array(found, np.int64).reshape(-1, 4).T
            keep = (covered <= max_covered * n) & (longest <= max_repeat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, covered, longest, intervals, keep))], schema=out)

    out = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_chars", "covered_chars", "longest_repeat", "n_intervals")), ("keep", pa.bool_())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(measure), _FIELDS)


def without_repetitive(
    docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """`docs`, all columns, without the rows that the rules reject."""

    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (repetition(t, min_repeat) for t in texts.to_pylist())
            yield pa.array([covered <= max_covered * n and longest <= max_repeat for n, covered, longest, _ in found], pa.bool_())
        trim()

    # only the texts go to Python, and only the decision comes back
    return docs.where(F.arrow_udf(keep, "boolean")(text_column(docs)))
