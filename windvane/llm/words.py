"""Words ``[^\\x20\\x09-\\x0D]+`` of whole texts as 64-bit hashes, found for many texts at once in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, taken from one running sum over a slice of the batch and
mixed at the end. A slice holds many short texts or a piece of a long one, so memory follows the slice and, for the
hashes, the longest text; no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
U64 = np.uint64
_K = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(k: int) -> np.ndarray:
        out = np.full(n, k, U64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return series(_K), series(pow(_K, -1, 1 << 64))


@lru_cache(maxsize=3)
def _tables(kind: str = "word") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that belong to words, hash values of bytes, and of lower-cased bytes.

    Kinds: ``word`` is what stands between spaces, ``letters`` are runs of ASCII letters, digits and bytes of other
    characters, ``symbols`` are runs of ASCII punctuation.
    """
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    letters = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
    outside = {"word": space, "letters": ~letters, "symbols": letters | space | (np.arange(256) < 33)}[kind]
    value = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
    lower = value.copy()
    lower[65:91] = value[97:123]
    return ~outside, value, lower


def _slice_words(data: np.ndarray, cuts: np.ndarray, lower: bool, kind: str = "word", prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in ``data``; no word crosses a cut (positions where a text begins)."""
    inside, plain, lowered = _tables(kind)
    part = inside[data]
    begins, ends = part.copy(), part.copy()
    begins[1:] &= ~part[:-1]
    ends[:-1] &= ~part[1:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = part[cuts]
    ends[cuts - 1] = part[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    size = 1 << max(SLICE, len(data) + 1).bit_length()
    power, inverse = _powers(size)
    running = np.empty(len(data) + 1, U64)
    running[0] = 0
    np.cumsum((lowered if lower else plain)[data] * power[: len(data)], out=running[1:])
    to = np.minimum(end, start + prefix) if prefix else end
    return start, end, mix((running[to] - running[start]) * inverse[start] + (to - start).astype(U64))


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without NULLs, and where each text begins (one more for the end)."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of consecutive texts of about ``size`` bytes together; a longer text is alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def word_spans(column: pa.Array, lower: bool = True, kind: str = "word", prefix: int = 0) -> Iterator[tuple]:
    """For runs of texts: first and last text, words per text, hashes of all their words in order, and where these start and end in the column's bytes."""
    data, offsets = raw_bytes(column)
    inside = _tables(kind)[0]
    for first, last in groups(offsets):
        begin, end = offsets[first], offsets[last]
        if end - begin <= 4 * SLICE:
            start, stop, hashes = _slice_words(data[begin:end], offsets[first:last] - begin, lower, kind, prefix)
            edges = np.searchsorted(start, offsets[first : last + 1] - begin)
            yield first, last, np.diff(edges), hashes, start + begin, stop + begin
            continue
        found = []  # one long text, in pieces that end behind a space
        at = begin
        while at < end:
            to = min(at + 2 * SLICE, end)
            while to < end and inside[data[to - 1]]:
                gap = np.flatnonzero(~inside[data[to : to + SLICE]])
                to = to + int(gap[0]) + 1 if len(gap) else min(to + SLICE, end)
            start, stop, hashes = _slice_words(data[at:to], np.zeros(0, np.int64), lower, kind, prefix)
            found.append((hashes, start + at, stop + at))
            at = to
        hashes, start, stop = (np.concatenate(x) for x in zip(*found))
        yield first, last, np.array([len(hashes)]), hashes, start, stop


def words_of(column: pa.Array, lower: bool = True, kind: str = "word", prefix: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first and last text, words per text, and the hashes of all their words (or first ``prefix`` bytes) in order."""
    for first, last, counts, hashes, _, _ in word_spans(column, lower, kind, prefix):
        yield first, last, counts, hashes


def word_counts(column: pa.Array) -> np.ndarray:
    """Number of words of every text; slices keep the memory small, whatever the texts' lengths."""
    data, offsets = raw_bytes(column)
    inside = _tables()[0]
    counts = np.zeros(len(offsets) - 1, np.int64)
    for at in range(0, len(data), 4 * SLICE):
        part = inside[data[at : at + 4 * SLICE]]
        begins = part.copy()
        begins[1:] &= ~part[:-1]
        if at and len(part) and part[0] and inside[data[at - 1]]:
            begins[0] = False
        cuts = offsets[(offsets >= at) & (offsets < at + len(part))] - at
        begins[cuts] = part[cuts]
        starts = np.flatnonzero(begins) + at
        counts += np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(counts))[: len(counts)]
    return counts
