"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select ``WEIGHT`` word positions out of a short span and ignore the others, so a substituted word spoils only
the seeds that look at it. Seeds of all benchmark items and of all documents are joined; every seed hit names a
diagonal (document position minus item position), and along it whole texts are compared word by word: an overlap
counts where a window of ``WINDOW`` words (the whole item, if shorter) has at least ``PERCENT`` equal words. Items
shorter than the masks' span get one mask for every choice of as many words as have to be equal, so none is missed.

Before the join, document seeds are checked against three bitmaps of fixed size over the benchmark's seeds, so only
likely hits are shuffled, however large the corpus; a larger benchmark only makes the check less sharp.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import BITMAP_BITS, bitmap, content_key, saved, text_column, text_rows, texts_of
from windvane.llm.words import U64, mix, words_of

# Word positions that each mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 5, 6), (0, 2, 3, 6, 8), (0, 1, 4, 6, 8), (0, 2, 5, 7, 8), (0, 3, 4, 6, 7))
SPAN = 9
WEIGHT = 5
WINDOW = 13
PERCENT = 75
_FACTOR = mix(np.arange(7001, 7001 + SPAN, dtype=U64)) | U64(1)
# With twelve words, the only three substitutions that all masks meet leave these words.
_TWELVE, _TWELVE_MASK = 12, (0, 1, 2, 5, 6)
_SHIFTS = (0, 20, 40)
_KEY = ["doc_id", "mark", "size"]


def _seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Seeds of one mask at every position where it fits."""
    size = max(0, len(hashes) - mask[-1])
    total = np.full(size, sum(1 << p for p in mask), U64)
    for factor, place in zip(_FACTOR, mask):
        total += hashes[place : place + size] * factor
    return mix(total)


def _masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of ``n`` words."""
    if n < WEIGHT:
        return []
    if n < SPAN:
        return list(combinations(range(n), -(-PERCENT * n // 100)))
    return [*MASKS, _TWELVE_MASK] if n == _TWELVE else list(MASKS)


def _texts(batches):
    """Batches with, for each text, its row and its word hashes."""
    for batch in batches:
        row = 0
        for _, _, counts, hashes in words_of(text_column(batch)):
            at = 0
            for n in counts.tolist():
                yield batch, row, hashes[at : at + n]
                row, at = row + 1, at + n


def _item_seeds(batches):
    for batch, row, hashes in _texts(batches):
        n = len(hashes)
        if n < WEIGHT:
            continue
        masks = _masks(n)
        seeds = [_seeds(hashes, mask) for mask in masks]
        where = np.concatenate([np.arange(len(s)) for s in seeds])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(seeds).view(np.int64)), pa.array([batch.column(0)[row].as_py()] * len(where), pa.int64()), pa.array([batch.column(1)[row].as_py()] * len(where), pa.int64()),
             pa.array(where, pa.int32()), pa.array([n] * len(where), pa.int32())],
            names=["seed", "item", "item_id", "item_pos", "n"],
        )


def _document_seeds(bits, masks):
    """Positions whose seed may be one of the benchmark's."""

    def find(batches):
        tables = bits.value
        for batch in batches:
            index, seed_of, pos_of, row = [], [], [], 0
            for _, _, counts, hashes in words_of(text_column(batch)):
                ends = np.cumsum(counts)
                for mask in masks:
                    seeds = _seeds(hashes, mask)
                    at = np.arange(len(seeds))
                    for shift, table in zip(_SHIFTS, tables):
                        bit = (seeds[at] >> U64(shift)) & U64(BITMAP_BITS - 1)
                        at = at[(table[bit >> U64(6)] >> (bit & U64(63)) & U64(1)).astype(bool)]
                    text = np.searchsorted(ends, at, side="right")
                    inside = at + mask[-1] < ends[text]
                    at, text = at[inside], text[inside]
                    index.append(text + row)
                    seed_of.append(seeds[at])
                    pos_of.append(at - (ends - counts)[text])
                row += len(counts)
            rows = pa.array(np.concatenate(index) if index else [], pa.int64())
            if len(rows):
                keys = [batch.column(batch.schema.get_field_index(n)).take(rows) for n in _KEY]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.concatenate(seed_of).view(np.int64)), pa.array(np.concatenate(pos_of), pa.int64())], names=[*_KEY, "seed", "pos"])

    return find


def overlap(words: np.ndarray, item: np.ndarray, diagonal: int, window: int = WINDOW, percent: int = PERCENT) -> tuple[int, int, int]:
    """First item position, covered words and equal words of the windows along a diagonal that are similar enough."""
    window = min(window, len(item))
    low, high = max(0, -diagonal), min(len(item), len(words) - diagonal)
    if high - low < window or window < WEIGHT:
        return 0, 0, 0
    equal = words[low + diagonal : high + diagonal] == item[low:high]
    sums = np.convolve(equal, np.ones(window, np.int64), "valid")
    starts = np.flatnonzero(100 * sums >= percent * window)
    if not len(starts):
        return 0, 0, 0
    edges = np.zeros(len(equal) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return int(low + starts[0]), int(covered.sum()), int((covered & equal).sum())


def _verify(batches):
    names = ["doc_id", "mark", "size", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
    for batch in batches:
        rows = []
        doc_text = item_text = words = item = None
        texts, items, diagonals = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "item_text", "diagonals"))
        for i in range(batch.num_rows):
            # Rows of one document come together mostly: hash its words once.
            if (text := texts[i].as_py()) != doc_text:
                doc_text, words = text, np.concatenate([h for _, _, _, h in words_of(pa.array([text]))])
            if (text := items[i].as_py()) != item_text:
                item_text, item = text, np.concatenate([h for _, _, _, h in words_of(pa.array([text]))])
            best = (0, 0, 0, 0)
            for diagonal in sorted(diagonals[i].as_py()):
                start, covered, equal = overlap(words, item, diagonal)
                if equal > best[3]:
                    best = (start + diagonal, start, covered, equal)
            if best[3]:
                rows.append((*(batch.column(batch.schema.get_field_index(n))[i].as_py() for n in names[:4]), *best))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(8)], names=names)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, mark, size, item_id, doc_start, item_start, n_words, n_equal.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Of several overlaps of a pair, the one with most equal
    words is given (then the first): where it starts, words covered, words equal.

    * NULL or empty texts overlap with nothing, nor do items of fewer than five words: too little evidence.
    * Rows that repeat id and text give one result; so do repeated items. NULL ids are kept as they are.
    * Empty tables give an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = text_rows(documents, id_column, text_column)
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("item_text")).distinct()
    items = saved(items.withColumn("item", F.xxhash64(F.monotonically_increasing_id())), "items")
    seeds = items.select("item", "item_id", F.col("item_text").alias("text")).mapInArrow(_item_seeds, "seed long, item long, item_id long, item_pos int, n int")
    seeds = saved(seeds, "seeds")
    lengths = [r["n"] for r in seeds.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().orderBy("n").collect()]
    tables = [bitmap(seeds.select(F.shiftrightunsigned("seed", s).alias("seed")), "seed", hashed=True) for s in _SHIFTS]
    masks = list(dict.fromkeys(mask for n in lengths for mask in _masks(n)))
    hits = docs.select("doc_id", "text", *content_key()).mapInArrow(_document_seeds(spark.sparkContext.broadcast(tables), masks), "doc_id long, mark long, size int, seed long, pos long")
    met = hits.join(seeds.select("seed", "item", "item_pos"), "seed").select(*_KEY, "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    pairs = saved(met.groupBy(*_KEY, "item").agg(F.collect_set("diagonal").alias("diagonals")), "pairs")
    texts = texts_of(docs, saved(pairs.select(*_KEY).distinct(), "needed")).dropDuplicates(_KEY)
    named = texts.select(F.col("text"), *[F.col(c).alias(f"_{c}") for c in _KEY])
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark")) & (F.col("size") == F.col("_size"))
    both = pairs.join(named, same).join(items, "item").select(*_KEY, "item_id", "text", "item_text", "diagonals")
    found = both.mapInArrow(_verify, "doc_id long, mark long, size long, item_id long, doc_start long, item_start long, n_words long, n_equal long")
    return found.withColumn("size", F.col("size").cast("int")).dropDuplicates(["doc_id", "mark", "size", "item_id", "doc_start", "item_start", "n_words", "n_equal"])
