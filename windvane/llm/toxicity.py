"""Toxicity from class-conditional Kneser-Ney models.

Bigram counts of toxic and of ordinary training texts give two interpolated Kneser-Ney models. Each class backs off
from bigrams to its own continuation counts, and both levels add counts that the classes share in proportion to their
sizes, so an expression that is rare in either class is smoothed to nearly the same value in both and says little. A text's score
is a calibrated function of the difference of its log likelihoods per word: of the whole text and of its most toxic
stretch of ``STRETCH`` words and of one word, since a few words make a long text toxic. Words are seen twice, as they
are and as their first ``STEM`` bytes, so that compounds and inflections of one stem share their evidence.

All n-grams of the sample count, also those seen once. They are counted once, per label and half of the sample; the two
half models (for calibration) and the whole one are sums of those counts. The sample is bounded in documents and bytes,
hence also the model: at most a bigram for every word and every stem, six bytes each when compressed. Tasks pack it into
sorted, compressed arrays, part by part; the driver only hands these on as one broadcast. A bigram is the pair of
31-bit hashes of its words.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import saved, text_column, text_rows
from windvane.llm.labels import judged, labelled_sample
from windvane.llm.words import U64, mix, words_of

MAX_ROWS = 10_000  # labelled documents per class, at most
MAX_BYTES = 48 << 20  # of their texts per class, at most
DISCOUNT = 0.75
SHARED = 10.0  # shared backoff counts of every word, and of every occurrence of a bigram, split by the classes' sizes
STRENGTH = 50.0  # of the backoff from bigrams to words, split likewise
STRETCH = 8
STEM = 5
THRESHOLD = 0.7
_START = U64(0x5BD1E995)  # stands before a text's first word
_BITS = U64(31)
_MASK = U64((1 << 31) - 1)
# Halves of the sample that a model counts: one of them, or both.
MODELS = ((0,), (1,), (0, 1))
# Per word: bigrams that end in it (of each class, of any), bigrams that begin with it, and how often these occur.
STATS = ("c0", "c1", "c", "k0", "k1", "m0", "m1")


def _bigrams(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The word before each word (a start mark at a text's begin) and the word, as one number."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = _START
    return (before << _BITS) | words


def _streams(column: pa.Array):
    """Runs of texts: (first, last, words per text, 31-bit hashes of words, of stems)."""
    for whole, stem in zip(words_of(column, kind="letters"), words_of(column, kind="letters", prefix=STEM)):
        yield (*whole[:3], whole[3] >> U64(33), mix(stem[3] ^ U64(0xA5A5A5A55A5A5A5A)) >> U64(33))


def _count(batches):
    """Bigrams of runs of texts with their counts; ``of`` is twice the label and the half of the sample."""
    for batch in batches:
        of = batch.column(1).to_numpy()
        for first, last, counts, *streams in _streams(text_column(batch)):
            for words in streams if len(streams[0]) else ():
                pairs, own = _bigrams(words, counts), np.repeat(of[first:last], counts)
                for k in np.unique(own):
                    key, n = np.unique(pairs[own == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), k, np.int32)), pa.array(n.astype(np.int32))], names=["key", "of", "n"])


def _squeezed(sorted_keys: np.ndarray, numbers: list[np.ndarray]) -> bytes:
    """Sorted keys (as steps of their upper and their lower bits) and non-negative numbers, compressed."""
    upper, lower = (sorted_keys >> _BITS).astype(np.uint32), (sorted_keys & _MASK).astype(np.uint32)
    small = [n.astype(np.min_scalar_type(int(n.max(initial=0)))) for n in numbers]
    arrays = [np.diff(upper, prepend=np.uint32(0)), lower, *small]
    return pickle.dumps([(a.dtype.str, zlib.compress(a.tobytes(), 1)) for a in arrays])


def _unpacked(blobs: list[bytes], sums: list[list[int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of parts in order, and for each list of columns their sum, in the smallest type."""
    keys, totals = [np.zeros(0, np.uint64)], [[np.zeros(0, np.uint8)] for _ in sums]
    for blob in blobs:
        arrays = pickle.loads(blob)
        column = lambda i: np.frombuffer(zlib.decompress(arrays[i][1]), arrays[i][0])
        keys.append((np.cumsum(column(0), dtype=np.uint64) << _BITS) | column(1).astype(np.uint64))
        for parts, columns in zip(totals, sums):
            total = sum(column(2 + i).astype(np.uint64) for i in columns)
            parts.append(total.astype(np.min_scalar_type(int(total.max(initial=0)))))
    return np.concatenate(keys), [np.concatenate(parts) for parts in totals]


def _pack(batches):
    """One record per task: its sorted keys and their numbers."""
    parts = [[b.column(i).to_numpy() for i in range(b.num_columns)] for b in batches]
    if parts:
        columns = [np.concatenate(c) for c in zip(*parts)]
        yield pa.RecordBatch.from_arrays([pa.array([int(columns[0][0])]), pa.array([_squeezed(columns[0].view(np.uint64), columns[1:])])], names=["first", "blob"])


def _packed(table: DataFrame, name: str) -> DataFrame:
    """A table of keys (first column, range-partitioned) and numbers as compressed parts."""
    return saved(table.sortWithinPartitions(table.columns[0]).mapInArrow(_pack, "first long, blob binary"), name)


def counted(sample: DataFrame) -> DataFrame:
    """Parts of the sorted bigrams with n00, n01, n10, n11 (label, half)."""
    found = sample.select("text", (F.col("label") * 2 + F.col("part")).alias("of")).mapInArrow(_count, "key long, of int, n int")
    sums = [F.sum(F.when(F.col("of") == 2 * c + h, F.col("n")).otherwise(0)).alias(f"n{c}{h}") for c in (0, 1) for h in (0, 1)]
    # The ranges also serve the aggregate: there is one shuffle.
    return _packed(found.repartitionByRange("key").groupBy("key").agg(*sums), "pairs")


def _stats(batches):
    """Partial ``STATS`` of every model for the words of a part."""
    names = ["word", *[f"{s}_{v}" for v in range(len(MODELS)) for s in STATS]]
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            keys, n = _unpacked([blob], [[i] for i in range(4)])
            counts = [[sum(n[2 * c + h].astype(np.int64) for h in halves) for c in (0, 1)] for halves in MODELS]
            for word, ends in ((keys & _MASK, True), (keys >> _BITS, False)):
                known, at = np.unique(word, return_inverse=True)
                columns = []
                for n0, n1 in counts:
                    seen = [np.bincount(at, x > 0, len(known)).astype(np.int64) for x in (n0, n1, n0 + n1)]
                    times = [np.bincount(at, x, len(known)).astype(np.int64) for x in (n0, n1)]
                    none = np.zeros(len(known), np.int64)
                    columns += [*seen, none, none, none, none] if ends else [none, none, none, *seen[:2], *times]
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), *map(pa.array, columns)], names=names)


def packed_words(pairs: DataFrame) -> DataFrame:
    """Parts of the sorted words with their ``STATS`` of every model."""
    names = [f"{s}_{v}" for v in range(len(MODELS)) for s in STATS]
    found = pairs.mapInArrow(_stats, "word long, " + ", ".join(f"{n} long" for n in names))
    return _packed(found.repartitionByRange("word").groupBy("word").agg(*[F.sum(n).alias(n) for n in names]), "words")


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Sample:
    """The packed counts of a sample, as they are broadcast; a Python worker unpacks one model at a time."""

    def __init__(self, pairs: DataFrame, words: DataFrame):
        self.pairs, self.words = ([r["blob"] for r in parts.orderBy("first").collect()] for parts in (pairs, words))
        self._model: tuple = (None, None)

    def __getstate__(self):
        return self.pairs, self.words

    def __setstate__(self, state):
        (self.pairs, self.words), self._model = state, (None, None)

    def model(self, which: int) -> KneserNey:
        if self._model[0] != which:
            self._model = (None, None)  # its memory goes before the next one is unpacked
            self._model = (which, KneserNey(self, which))
        return self._model[1]


class KneserNey:
    """Both classes' models of some halves: words (two probabilities, backoff weights and masses) and bigrams (two counts)."""

    def __init__(self, sample: Sample, which: int):
        self.pairs, self.counts = _unpacked(sample.pairs, [[2 * c + h for h in MODELS[which]] for c in (0, 1)])
        self.words, stats = _unpacked(sample.words, [[which * len(STATS) + i] for i in range(len(STATS))])
        c0, c1, c, k0, k1, m0, m1 = (x.astype(np.float64) for x in stats)
        every, vocabulary = max(c.sum(), 1), max((c > 0).sum(), 1)
        self.parts = [max(x.sum(), 1) / every for x in (c0, c1)]
        self.unigram, self.backoff, self.mass, self.rare = [], [], [], []
        for own, k, m, part in ((c0, k0, m0, self.parts[0]), (c1, k1, m1, self.parts[1])):
            mass = own.sum() + SHARED * vocabulary * part
            self.unigram.append(((np.maximum(own - DISCOUNT, 0) + c * (DISCOUNT * max((own > 0).sum(), 1) / every) + SHARED * part) / mass).astype(np.float32))
            self.rare.append(SHARED * part / mass)  # a word that is in no table has the shared counts only
            total = m + (m0 + m1) * (SHARED * part) + STRENGTH * part
            self.backoff.append(((k * DISCOUNT + STRENGTH * part) / total).astype(np.float32))
            self.mass.append(total.astype(np.float32))

    def _ratio(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood ratio of every word after the one before it, and of the word by itself."""
        joint, back = np.unique(_bigrams(hashes, counts), return_inverse=True)
        at, there = _look(self.words, joint & _MASK)
        from_, known = _look(self.words, joint >> _BITS)
        pair, met = _look(self.pairs, joint)
        logs, single = [], []
        for c in (0, 1):
            p = np.where(there, self.unigram[c][at], self.rare[c]) if len(self.words) else np.full(len(joint), self.rare[c])
            single.append(np.log(p))
            p = p * np.where(known, self.backoff[c][from_], 1.0) if len(self.words) else p
            if len(self.pairs):
                n0, n1 = (self.counts[k][pair].astype(float) for k in (0, 1))
                share = (np.maximum((n0, n1)[c] - DISCOUNT, 0.0) + SHARED * self.parts[c] * (n0 + n1)) / self.mass[c][from_]
                p = p + np.where(met, share, 0.0)
            logs.append(np.log(p))
        return (logs[1] - logs[0])[back], (single[1] - single[0])[back]

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: log likelihood ratio per word, of the highest stretch, of the highest word, log of the number of words.

        Stretch and word take the larger ratio of both levels: the counts that the classes share level a bigram seen a few
        times, which must not hide what its word says.
        """
        out = np.zeros((len(column), FEATURES))
        for first, last, counts, *streams in _streams(column):
            if not len(streams[0]):
                continue
            ratio, peak = (sum(r) for r in zip(*[(both, np.maximum(both, own)) for both, own in (self._ratio(words, counts) for words in streams)]))
            running, peaks = (np.concatenate([[0.0], np.cumsum(r)]) for r in (ratio, peak))
            filled = np.flatnonzero(counts)
            start = (np.cumsum(counts) - counts)[filled]
            end = start + counts[filled]
            # A stretch ends at a word and holds up to STRETCH words of the same text.
            begin = np.maximum(np.arange(len(ratio)) + 1 - STRETCH, np.repeat(start, counts[filled]))
            stretch = (peaks[1:] - peaks[begin]) / STRETCH
            out[first + filled] = np.stack(
                [(running[end] - running[start]) / counts[filled], np.maximum.reduceat(stretch, start), np.maximum.reduceat(peak, start), np.log1p(counts[filled])], axis=1
            )
        return out


FEATURES = 4
_COLUMNS = [f"x{k}" for k in range(FEATURES)]
_TYPES = ", ".join(f"{c} double" for c in _COLUMNS)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a ridge-penalised weighted logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        beta += np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (weight * (y - p)) - ridge * beta)
    return beta


def _featured(texts: DataFrame, keep: str, shared, which: int) -> DataFrame:
    """Features of all texts by one of the models, and the column to keep with its type."""
    name = keep.split()[0]

    def score(batches):
        for batch in batches:
            x = shared.value.model(which).features(text_column(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(FEATURES)]], names=[name, *_COLUMNS])

    return texts.select(name, "text").mapInArrow(score, f"{keep}, {_TYPES}")


def toxicity_scores(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted.

    Counts come from a bounded sample of labelled documents. It is calibrated on the same sample, each half scored by
    the counts of the other, weighted to the labels' own frequencies.

    * NULL and empty texts have no evidence and get the calibration's value for it; so do all texts if one of the
      classes has no labelled text (then 0).
    * Repeated rows are scored each on their own. An empty table gives an empty result. Other columns are not read.
    """
    sample, totals = labelled_sample(documents, labels, label, max_rows, MAX_BYTES)
    pairs = counted(sample)
    shared = documents.sparkSession.sparkContext.broadcast(Sample(pairs, packed_words(pairs)))
    # Each half is scored by the counts of the other.
    halves = [_featured(sample.filter(F.col("part") == part), "label int", shared, 1 - part).toPandas() for part in (0, 1)]
    fitted = pd.concat(halves)
    y = fitted["label"].to_numpy(float)
    beta = np.array([0.0] * FEATURES + [-30.0])
    if 0 < y.sum() < len(y):
        share = {c: totals[c] / max(1, (y == c).sum()) for c in (0, 1)}
        weight = np.where(y == 1, share[1], share[0])
        beta = _logistic(fitted[_COLUMNS].to_numpy(), y, weight * len(y) / weight.sum())
    scored = _featured(text_rows(documents), "doc_id long", shared, MODELS.index((0, 1)))
    line = F.lit(float(beta[-1])) + sum(F.lit(float(b)) * F.col(c) for b, c in zip(beta, _COLUMNS))
    scored = scored.withColumn("score", 1 / (1 + F.exp(-line)))
    return judged(scored, THRESHOLD)
