"""Sets of word shingles of whole texts, as sorted arrays of distinct 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from windvane.llm.words import U64, mix, words_of

WORDS = 5


def _factors(n: int) -> list[np.uint64]:
    return list(mix(np.arange(1, n + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The set of every text, in order: distinct ``words``-word shingles; of a shorter text the whole sequence; empty without words."""
    factors = _factors(words)
    for _, _, counts, hashes in words_of(column):
        size = max(0, len(hashes) - words + 1)
        rolled = np.zeros(size, U64)
        for i, factor in enumerate(factors):
            rolled += hashes[i : i + size] * factor
        rolled = mix(rolled)
        at = 0
        for n in counts.tolist():
            if n >= words:
                own = np.sort(rolled[at : at + n - words + 1])
                if len(own) > 1:
                    fresh = np.empty(len(own), bool)
                    fresh[0] = True
                    np.not_equal(own[1:], own[:-1], out=fresh[1:])
                    own = own[fresh]
                yield own
            elif n:
                with np.errstate(over="ignore"):
                    total = sum((h * f for h, f in zip(hashes[at : at + n], factors)), U64(n) << U64(56))
                yield mix(np.array([total], U64))
            else:
                yield np.zeros(0, U64)
            at += n


def similarity_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sets."""
    together = np.concatenate([a, b])
    together.sort(kind="stable")
    common = int(np.count_nonzero(together[1:] == together[:-1]))
    return common, len(a) + len(b) - common
