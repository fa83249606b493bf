"""Secrets in whole texts: named patterns, and windows of high entropy.

Three kinds of spans follow patterns: assignments to a secret's name, access keys and long hexadecimal runs. A fourth,
``entropy``, is found in candidate strings (runs of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters): a window
of ``WINDOW`` characters slides over the string, and its Shannon entropy, kept up by counts of the one character that
enters and the one that leaves, is held against the threshold of the narrowest character class that has all of the
window's characters. Windows that pass and touch are one span. Allow-lists suppress candidates that are plainly no
secrets, by what they are or by what stands before them; candidates that overlap a span of a pattern are not repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import text_rows

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# A match of these that is too short holds no longer one, so the least length may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED = 6  # characters at least

WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
# Least bits per character of a window, by character class. Random windows of 20 have about 3.5 (hex), 4.1 and 4.2
# bits, words glued together about 3.5; digits alone are numbers, letters alone words.
BITS = {"hex": 3.0, "alphanumeric": 3.75, "base64": 3.9}
# Strings that are no secrets whatever their entropy, and what names a string as none.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"(?i:.*(?:example|sample|dummy|placeholder|changeme|redacted|xxxx|0123456789|abcdefghij).*)",
    r"(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/](?:[A-Za-z]+|[0-9]{1,4}))*",
)
ALLOWED_AFTER = (
    r"(?i:(?:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|digest|integrity|commit|etag|uuid)\W{0,3})",
    r"(?i:base64,)",
    r"://\S{0,200}",
)
BEFORE = 240  # characters before a candidate that the second list sees

_SCALE = 1 << 24
_GAIN = [0] + [round(k * log2(k) * _SCALE) for k in range(1, WINDOW + 1)]
_DIGIT, _HEX_LOW, _HEX_UP, _LOW, _UP, _SIGN = range(6)


def _sort_of(character: str) -> int:
    if character.isdigit():
        return _DIGIT
    if character.isalpha():
        near = character.lower() <= "f"
        return (_HEX_LOW if near else _LOW) if character.islower() else (_HEX_UP if near else _UP)
    return _SIGN


_SORT = [_sort_of(chr(i)) if i < 128 else _SIGN for i in range(128)]


def _limit(sorts: list[int]) -> int:
    """Largest sum of k log k (scaled) with which a window of these sorts of characters passes; -1 for none."""
    digits, letters = sorts[_DIGIT], WINDOW - sorts[_DIGIT] - sorts[_SIGN]
    if not digits or not letters:
        return -1
    if not sorts[_LOW] and not sorts[_UP] and not sorts[_SIGN] and not (sorts[_HEX_LOW] and sorts[_HEX_UP]):
        return _LIMITS["hex"]
    return _LIMITS["base64" if sorts[_SIGN] else "alphanumeric"]


_LIMITS = {name: int((log2(WINDOW) - bits) * WINDOW * _SCALE) for name, bits in BITS.items()}


def entropy_windows(candidate: str) -> Iterator[tuple[int, int]]:
    """Maximal stretches of the candidate that are covered by touching windows which pass."""
    codes = candidate.encode("ascii")
    counts, sorts, total = [0] * 128, [0] * 6, 0
    begin = end = -1
    for i, code in enumerate(codes):
        if i >= WINDOW:
            gone = codes[i - WINDOW]
            total += _GAIN[counts[gone] - 1] - _GAIN[counts[gone]]
            counts[gone] -= 1
            sorts[_SORT[gone]] -= 1
        total += _GAIN[counts[code] + 1] - _GAIN[counts[code]]
        counts[code] += 1
        sorts[_SORT[code]] += 1
        if i >= WINDOW - 1 and total <= _limit(sorts):
            if begin >= 0 and i - WINDOW + 1 > end:
                yield begin, end
                begin = -1
            if begin < 0:
                begin = i - WINDOW + 1
            end = i + 1
    if begin >= 0:
        yield begin, end


class Scanner:
    """Finds spans in a text, with allow-lists of one's own if need be."""

    def __init__(self, allowed: tuple[str, ...] = ALLOWED, allowed_after: tuple[str, ...] = ALLOWED_AFTER):
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed) or r"(?!)")
        self.after = re.compile("(?:" + ("|".join(f"(?:{p})" for p in allowed_after) or r"(?!)") + r")\Z")

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the patterns, leftmost and not overlapping per kind."""
        found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGNED] if "=" in text or ":" in text else []
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return sorted(found)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All spans in order of start and kind."""
        base = self.base(text)
        covered: list[list[int]] = []  # what the patterns' spans cover together
        for start, _, end in base:
            if covered and start < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], end)
            else:
                covered.append([start, end])
        added, taken = [], 0
        for m in CANDIDATE.finditer(text):
            at, candidate = m.start(), m.group()
            while taken < len(covered) and covered[taken][1] <= at:
                taken += 1
            if (taken < len(covered) and covered[taken][0] < m.end()) or self.allowed.fullmatch(candidate):
                continue
            windows = [(at + a, 3, at + b) for a, b in entropy_windows(candidate)]
            if windows and not self.after.search(text[max(0, at - BEFORE) : at]):
                added += windows
        return sorted(base + added)


_SPANS = "array<struct<start: long, kind: string, end: long>>"


def secret_spans(documents: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id and spans (start, kind, end in code points, end exclusive; by start, then kind) of every document.

    NULL and empty texts have none. Repeated rows are scanned each on their own; an empty table gives an empty result;
    other columns are not read. There is no shuffle: a row needs only its own text, of any length.
    """
    scanner = scanner or Scanner()
    item = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])

    def scan(batches):
        for batch in batches:
            spans = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in scanner.spans(text)] if text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"])

    return text_rows(documents).mapInArrow(scan, f"doc_id long, spans {_SPANS}")


def secret_digests(documents: DataFrame) -> DataFrame:
    """Counts of the patterns' spans, the SHA-256 of their list, and the list of all spans as ``kind:start:end``."""
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in KINDS[:-1]]
    return secret_spans(documents).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
