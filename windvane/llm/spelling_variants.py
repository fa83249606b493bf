"""Spelling variants of words: neighbourhoods of one edit, guided by Bloom filters.

Words and their counts come from whole texts. The vocabulary is kept as a table and, for every word length, as a
blocked Bloom filter (a key sets ``PROBES`` bits of one 64-bit block). A word's edits are generated as hashes only: all
deletions, and all replacements by a larger character; insertions and smaller characters are the same pairs seen from
the other word. Hashes are polynomials over characters, so an edit's hash follows from the word's in constant time.
Edits that the filter of their length lets pass are written out and joined with the vocabulary, which is exact: what the
filter lets pass wrongly finds no word there.

A filter is broadcast per length and fetched only by tasks that meet that length. All filters together have at most
``MAX_BLOCKS`` blocks, whatever the vocabulary: beyond it more edits pass and are dropped by the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import saved, text_rows
from windvane.llm.words import U64, mix

LEAST_LENGTH, LEAST_COUNT = 5, 3
STRONGER = 2  # a form is at least so many times as frequent
ODDS = 97  # one in so many words of a document loses a character
BLOCK_WORDS = 2  # words to a block of 64 bits
PROBES = 5
MAX_BLOCKS = 1 << 23  # 64 MB
FLUSH = 200_000  # distinct words that a task counts before it hands them on
CHUNK = 1 << 19  # hashes computed at a time
_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_BASE = 0x9E3779B97F4A7C15 | 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of whole texts."""
    total: Counter = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for rows in batches:
        for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if not text:
                continue
            start = zlib.crc32(f"{'' if i is None else i}:".encode())
            # Bytes are lower-cased in ASCII only.
            for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                h = zlib.crc32(word.encode(), start)
                if h % ODDS == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                total[word] += n
            if len(total) >= FLUSH:
                yield batch()
                total.clear()
    if total:
        yield batch()


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n and size (characters) of all words that are long and frequent enough."""
    parts = text_rows(documents).mapInArrow(_counted, "word string, n long")
    words = parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    return words.withColumn("size", F.length("word"))


def _powers(length: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 1 << 64) for i in range(length + 1)], U64)


_INVERSE = U64(pow(_BASE, -1, 1 << 64))


def _codes(words: list[str], length: int) -> np.ndarray:
    """Characters of words of one length, one row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _terms(codes: np.ndarray) -> np.ndarray:
    """A character's share of a hash, before its place."""
    return mix(codes.astype(U64) * U64(0xD1B54A32D192ED03) + U64(1))


def hashes_of(words: list[str], length: int) -> np.ndarray:
    """Hashes of words of one length, not yet mixed."""
    return (_terms(_codes(words, length)) * _powers(length)[:length]).sum(axis=1, dtype=U64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """The words of a batch by length, and their row numbers."""
    size = batch.column(batch.schema.get_field_index("size")).to_numpy()
    words = batch.column(batch.schema.get_field_index("word"))
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        yield length, words.take(pa.array(rows)).to_pylist(), rows


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and bits of every hash."""
    mixed = mix(hashes)
    bits = np.zeros(len(mixed), U64)
    for k in range(PROBES):
        bits |= U64(1) << ((mixed >> U64(6 * k)) & U64(63))
    return ((mixed >> U64(32)) * U64(blocks)) >> U64(32), bits


def filters(words: DataFrame) -> dict[int, np.ndarray]:
    """A blocked Bloom filter for every word length; together at most ``MAX_BLOCKS`` blocks (and one per length)."""
    sizes = {r["size"]: r["count"] for r in words.groupBy("size").count().collect()}  # one row per length
    share = min(1.0, MAX_BLOCKS * BLOCK_WORDS / max(sum(sizes.values()), 1))
    blocks = {length: int(k * share / BLOCK_WORDS) + 1 for length, k in sizes.items()}

    def place(batches):
        for batch in batches:
            for length, own, _ in _by_length(batch):
                block, bits = _places(hashes_of(own, length), blocks[length])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), length, np.int32)), pa.array(block.astype(np.int32)), pa.array(bits.view(np.int64))], names=["size", "block", "bits"])

    set_ = words.select("word", "size").mapInArrow(place, "size int, block int, bits long").groupBy("size", "block").agg(F.bit_or("bits").alias("bits"))
    found = set_.toArrow()  # at most MAX_BLOCKS rows and one per length
    size, block, bits = (found.column(c).to_numpy() for c in ("size", "block", "bits"))
    out = {}
    for length, k in blocks.items():
        own = size == length
        out[length] = np.zeros(k, U64)
        out[length][block[own]] = bits[own].view(U64)
    return out


def _passing(bloom: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bloom is None:
        return np.zeros(len(hashes), bool)
    block, bits = _places(hashes, len(bloom))
    return (bloom[block.astype(np.int64)] & bits) == bits


def _edits(words: list[str], length: int, alphabet: np.ndarray, of) -> Iterator[tuple[int, str]]:
    """Edits of words of one length that pass their filter: number of the word, edited word. ``of`` gives a length's filter."""
    codes, power = _codes(words, length), _powers(length)
    terms = _terms(codes) * power[:length]
    upto = np.zeros((len(words), length + 1), U64)
    np.cumsum(terms, axis=1, out=upto[:, 1:])
    whole = upto[:, -1:]
    deleted = upto[:, :-1] + (whole - upto[:, 1:]) * _INVERSE
    passes = _passing(of(length - 1), deleted.ravel()).reshape(deleted.shape)
    # Of equal neighbours, only the first is deleted.
    passes[:, 1:] &= codes[:, 1:] != codes[:, :-1]
    for row, at in np.argwhere(passes):
        yield row, words[row][:at] + words[row][at + 1 :]
    given = _terms(alphabet)
    for at in range(length):
        replaced = (whole[:, 0] - terms[:, at])[:, None] + given * power[at]
        larger = alphabet > codes[:, at, None]
        row, letter = np.nonzero(larger)
        kept = _passing(of(length), replaced[row, letter])
        for r, c in zip(row[kept], letter[kept]):
            yield r, words[r][:at] + chr(alphabet[c]) + words[r][at + 1 :]


def near_pairs(words: DataFrame) -> DataFrame:
    """Every two words that differ by one edit, once: word, n, other, other_n."""
    context = words.sparkSession.sparkContext
    shards = {length: context.broadcast(bloom) for length, bloom in filters(words).items()}
    # At most the 90 characters that words are made of.
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint32)

    def probe(batches):
        of = lambda length: shards[length].value if length in shards else None
        names = ["word", "n", "other"]
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            for length, own, rows in _by_length(batch):
                step = max(1, CHUNK // max(len(alphabet), 1, length))
                for first in range(0, len(own), step):
                    part = own[first : first + step]
                    found = list(_edits(part, length, alphabet, of))
                    if found:
                        at = np.array([r for r, _ in found])
                        columns = [pa.array([part[r] for r in at], pa.string()), pa.array(n[rows[first + at]]), pa.array([x for _, x in found], pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    # By length, so that a task meets few filters.
    placed = words.repartitionByRange("size", F.xxhash64("word"))
    edits = placed.select("word", "n", "size").mapInArrow(probe, "word string, n long, other string")
    return edits.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for every word that has a form, by pointer jumping: steps double, and counts at least double at each.

    Words that have arrived take no part in later rounds, so a root that very many words share is no key of a join.
    """
    at = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    known = at.select(F.col("word").alias("root"), F.lit(True).alias("more"))
    at = saved(at.join(known, "root", "left").select("word", "root", F.coalesce("more", F.lit(False)).alias("more")), "roots")
    while at.filter("more").head(1):
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("far"), F.col("more").alias("further"))
        moved = at.filter("more").select("word", "root").join(ahead, "root").select("word", F.col("far").alias("root"), F.col("further").alias("more"))
        at = saved(at.filter("NOT more").unionByName(moved), "roots")
    return at.select("word", "root")


def variant_forms(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: see the contract of op11.

    * NULL and empty texts have no words; a NULL doc_id counts as an empty one. Repeated rows count each on their own.
    * Of near words that are equally frequent, the form is the first in code-point order.
    * An empty table gives an empty result. Other columns are not read.
    """
    words = saved(vocabulary(documents), "words")
    pairs = saved(near_pairs(words), "pairs")
    both = pairs.select("word", "n", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= STRONGER * F.col("n")
    forms = words.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    forms = saved(forms, "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
