"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a sparse random index vector, drawn from its hash. A word's vector is the sum of the index vectors of
its neighbours over all documents; words share ``BUCKETS`` rows by hash, so the table has a fixed size and may be
broadcast. Words and runs of punctuation are words here, in their own case. A document is the mean of the normalised
vectors of its words and of their squares; a two-layer network in numpy, trained on a bounded sample of labelled
documents, gives its probability, calibrated by a temperature on documents the network has not seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import text_column, text_rows
from windvane.llm.labels import judged, labelled_sample
from windvane.llm.words import U64, mix, words_of

BUCKETS = 4096
WIDTH = 32
NONZERO = 4
REACH = 2
HIDDEN = 32
MAX_ROWS = 10_000  # labelled documents per class, at most
THRESHOLD = 0.5
_KINDS = ("letters", "symbols")


def _tokens(column: pa.Array):
    """Both kinds of words of runs of texts: (first, last, [(counts, hashes) per kind])."""
    for a, b in zip(*(words_of(column, lower=False, kind=kind) for kind in _KINDS)):
        yield a[0], a[1], [(a[2], a[3]), (b[2], b[3])]


def _index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the index vectors."""
    draws = np.stack([mix(hashes + U64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(NONZERO)])
    return (draws % U64(WIDTH)).astype(np.int64), np.where(draws >> U64(63), 1.0, -1.0)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(20)).astype(np.int64) & (BUCKETS - 1)


def _neighbours(batches):
    total = np.zeros(BUCKETS * WIDTH)
    for batch in batches:
        for _, _, kinds in _tokens(text_column(batch)):
            for counts, hashes in kinds:
                owner = np.repeat(np.arange(len(counts)), counts)
                row = _bucket(hashes) * WIDTH
                place, sign = _index(hashes)
                cells, signs = [], []
                for step in range(1, REACH + 1):
                    same = owner[step:] == owner[:-step]
                    for row_of, other in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                        cells.append((row[row_of][same] + place[:, other][:, same]).ravel())
                        signs.append(sign[:, other][:, same].ravel())
                if cells and len(owner):
                    total += np.bincount(np.concatenate(cells), np.concatenate(signs), minlength=len(total))
    at = np.flatnonzero(total)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["cell", "n"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of word vectors over all texts, rows normalised."""
    cells = texts.select("text").mapInArrow(_neighbours, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(BUCKETS * WIDTH)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    table = table.reshape(BUCKETS, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Per text: mean vector and mean square of words and of symbols, share of symbols, log of the number of words."""
    out = np.zeros((len(column), 4 * WIDTH + 2), np.float32)
    for first, last, kinds in _tokens(column):
        for k, (counts, hashes) in enumerate(kinds):
            filled = np.flatnonzero(counts)
            if not len(filled):
                continue
            vectors = table[_bucket(hashes)]
            at = (np.cumsum(counts) - counts)[filled]
            n = counts[filled, None]
            out[first + filled, 2 * k * WIDTH : (2 * k + 1) * WIDTH] = np.add.reduceat(vectors, at) / n
            out[first + filled, (2 * k + 1) * WIDTH : (2 * k + 2) * WIDTH] = np.add.reduceat(vectors * vectors, at) / n
        both = kinds[0][0] + kinds[1][0]
        out[first:last, -2] = kinds[1][0] / np.maximum(both, 1)
        out[first:last, -1] = np.log1p(both) / 10
    return out


class Network:
    """Two layers, trained with Adam on class-balanced cross entropy plus weight decay; then a temperature and an offset."""

    def __init__(self, width: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature, self.offset = 1.0, 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.scale @ a + b) @ c + d[0]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        draw = np.random.default_rng(5)
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for at in range(0, len(x), 128):
                own = order[at : at + 128]
                a, b, c, d = self.weights
                hidden = np.tanh(x[own] @ a + b)
                slope = weight[own] * (1 / (1 + np.exp(-np.clip(hidden @ c + d[0], -30, 30))) - y[own]) / len(own)
                inner = slope[:, None] * c * (1 - hidden**2)
                step += 1
                for k, g in enumerate((x[own].T @ inner + decay * a, inner.sum(axis=0), hidden.T @ slope + decay * c, np.array([slope.sum()]))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the smallest weighted log loss, and the offset to the labels' own frequencies."""
        raw = self.logits(x)

        def loss(t, o):
            z = np.clip(raw / t + o, -30, 30)
            return float((weight * (np.logaddexp(0, z) - y * z)).sum())

        grid = [(loss(t, o), t, o) for t in np.geomspace(0.25, 8, 26) for o in np.linspace(-4, 4, 33)]
        _, self.temperature, self.offset = min(grid)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature + self.offset, -30, 30)))


def quality_scores(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted.

    Word vectors come from all texts; labels from a bounded sample of the documents that are not held out.

    * NULL and empty texts have a zero vector and get the network's value for it.
    * If one of the classes has no labelled text, every score is 0.5.
    * Repeated rows are scored each on their own. An empty table gives an empty result. Other columns are not read.
    """
    spark = documents.sparkSession
    docs = text_rows(documents)
    table = spark.sparkContext.broadcast(word_vectors(docs))
    sample, totals = labelled_sample(documents, labels, label, max_rows)

    def features(batches):
        for batch in batches:
            x = pooled(text_column(batch), table.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([row.tobytes() for row in x], pa.binary())], names=["label", "part", "x"])

    rows = sample.select("text", "label", "part").mapInArrow(features, "label int, part int, x binary").orderBy("label", "part", "x").toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, 4 * WIDTH + 2).astype(float)
    y, fitting = rows["label"].to_numpy(float), rows["part"].to_numpy() == 0
    network = None
    if 0 < y[fitting].sum() < fitting.sum() and 0 < y[~fitting].sum() < (~fitting).sum():
        network = Network(x.shape[1])
        share = y[fitting].mean()
        network.fit(x[fitting], y[fitting], np.where(y[fitting] == 1, 0.5 / share, 0.5 / (1 - share)))
        own = {c: totals[c] / (y[~fitting] == c).sum() for c in (0, 1)}
        network.calibrate(x[~fitting], y[~fitting], np.where(y[~fitting] == 1, own[1], own[0]))
    model = spark.sparkContext.broadcast(network)

    def score(batches):
        for batch in batches:
            found = np.full(batch.num_rows, 0.5) if model.value is None else model.value.probability(pooled(text_column(batch), table.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return judged(docs.mapInArrow(score, "doc_id long, score double"), THRESHOLD)
