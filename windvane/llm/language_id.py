"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting runs on all training texts: every task sums its own n-gram buckets per language, Spark adds them up. The
matrix of log probabilities (buckets x languages, so of bounded size) is broadcast, and batches of texts are scored
in numpy by gathering the rows of the n-grams they hold.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.words import SLICE, groups, raw_bytes

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.1
MAX_LANGUAGES = 1000  # the matrix stays below 131 MB
_ODD = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _ngrams(texts: list[str]):
    """For each order, buckets of all n-grams and the index of their text; letters are lower-cased, other runs become one space."""
    text = "".join(f" {t} " for t in texts).lower()
    if len(text) != sum(map(len, texts)) + 2 * len(texts):  # lower-casing changed lengths: do it text by text
        texts = [t.lower() for t in texts]
        text = "".join(f" {t} " for t in texts)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & ~letter[:-1]
    codes, owner = np.where(letter, codes, np.uint32(32))[keep], owner[keep]
    for n in ORDERS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, n, np.uint32)
        for i in range(n):
            h = (h + codes[i : i + size]) * _ODD[i]
            h ^= h >> np.uint32(15)
        bucket = (h >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1)
        if n == 1:
            yield bucket, owner
        else:
            whole = owner[:size] == owner[n - 1 :]
            yield bucket[whole], owner[:size][whole]


def _runs(column):
    """Texts in runs of bounded size: (index of each text, texts); a long text comes in several parts that overlap by an n-gram."""
    _, offsets = raw_bytes(column)
    for first, last in groups(offsets):
        texts = column.slice(first, last - first).to_pylist()
        if len(texts) > 1 or len(texts[0]) <= 4 * SLICE:
            yield np.arange(first, last), texts
        else:
            for at in range(0, len(texts[0]), 4 * SLICE):
                yield np.array([first]), [texts[0][at : at + 4 * SLICE + ORDERS[-1] - 1]]


def _count(languages: list[str]):
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        import pyarrow as pa

        from windvane.llm.common import text_column

        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for index, texts in _runs(text_column(batch)):
                own = langs[index] * BUCKETS
                for bucket, owner in _ngrams(texts):
                    total += np.bincount(own[owner] + bucket, minlength=len(total))
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    return count


class LanguageModel:
    """Languages, their log priors and the matrix of log probabilities, one row per language."""

    def __init__(self, languages: list[str], priors: np.ndarray, matrix: np.ndarray):
        self.languages, self.priors, self.matrix = languages, priors, matrix

    @classmethod
    def fit(cls, labelled: DataFrame) -> LanguageModel:
        """From ``text`` and non-null ``lang``; all rows count."""
        docs = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect())
        if len(docs) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        languages = [lang for lang, _ in docs]
        if not languages:
            return cls([], np.zeros(0), np.zeros((0, BUCKETS), np.float32))
        cells = labelled.select("text", "lang").mapInArrow(_count(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros(len(languages) * BUCKETS)
        counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy()
        counts = counts.reshape(-1, BUCKETS) + SMOOTHING
        priors = np.log(np.array([n for _, n in docs], float))
        return cls(languages, priors - np.logaddexp.reduce(priors), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))

    def score(self, texts: DataFrame) -> DataFrame:
        """``row`` (all columns, as a struct), lang_pred, score: posterior of that language, ties go to the first by code point; and letter (has the text one?)."""
        model = texts.sparkSession.sparkContext.broadcast((self.languages, self.priors, self.matrix))

        def predict(batches):
            import pyarrow as pa

            from windvane.llm.common import text_column

            languages, priors, matrix = model.value
            for batch in batches:
                column = text_column(batch)
                total = np.zeros((len(languages), batch.num_rows))
                letters = np.zeros(batch.num_rows, np.int64)
                for index, parts in _runs(column):
                    for order, (bucket, owner) in enumerate(_ngrams(parts)):
                        if not len(owner):
                            continue
                        at = np.flatnonzero(np.diff(owner, prepend=-1))
                        to = index[owner[at]]
                        if order == 0:
                            letters[to] += np.diff(np.append(at, len(owner)))
                        for i in range(len(languages)):
                            total[i, to] += np.add.reduceat(matrix[i][bucket], at, dtype=np.float64)
                total += priors[:, None]
                if languages:
                    best = total.argmax(axis=0)
                    score = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                known = (letters > 0) & bool(languages)
                names = [languages[best[i]] if known[i] else "und" for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0) if languages else np.zeros(batch.num_rows)), pa.array(letters > 0)],
                    names=["row", "lang_pred", "score", "letter"],
                )

        kind = texts.schema["row"].dataType.simpleString()
        return texts.select("row", "text").mapInArrow(predict, f"row {kind}, lang_pred string, score double, letter boolean")


def held_out(id_column: str, parts: int, remainder: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``remainder``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts == remainder


def predicted(documents: DataFrame, keep: list[str], parts: int = 5, remainder: int = 0) -> DataFrame:
    """Predict the language of every whole text: ``row`` with the columns to keep, lang_pred, score, letter.

    Learns from text and non-null lang of the rows that are not held out.

    * ``und`` with score 0 if the text is NULL, has no letter, or nothing was learned; NULL langs are not learned.
    * Repeated rows count and are scored each on their own. An empty table gives an empty result.
    """
    docs = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out("doc_id", parts, remainder).alias("out"))
    model = LanguageModel.fit(docs.filter(~F.col("out") & F.col("lang").isNotNull()).select("text", "lang"))
    return model.score(docs.select("row", "text"))


def language_predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    found = predicted(documents, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), "lang_pred", "score")
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
