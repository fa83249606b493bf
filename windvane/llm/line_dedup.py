"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

Documents arrive in batches. ``LineRuns`` keeps, for every line key met so far, the document that holds it first, as
sorted runs on levels: each batch merge-anti-joins the runs, writes what is new as a run of level 0, and a level with
``fanout`` runs is compacted into one run of the next level. A key is in one run only. Runs live in the shared folder,
so an index can outlive a query (``LineRuns.runs`` are folders) and a lost executor costs a re-read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane.llm.common import SPACES, saved, shared_folder

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2", "n"]
_LAST = (1 << 63) - 1


class LineRuns:
    """Line keys and their first documents, as sorted runs on levels."""

    schema = "h1 long, h2 int, n int, first long"

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    @property
    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def read(self, *runs: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*runs)

    def _write(self, firsts: DataFrame) -> str:
        folder = shared_folder(self.spark, "run")
        # A key is there once, so a hash on it deals evenly; sorted files compress and merge.
        firsts.repartition(*_KEY).sortWithinPartitions(*_KEY).write.parquet(folder)
        return folder

    def compact(self) -> None:
        """Merge every full level into one run of the next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self.read(*self.levels[level])))
                self.levels[level] = []
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of lines (``place`` of the document, key); returns its keys with their first documents."""
        self.compact()
        fresh = lines.groupBy(*_KEY).agg(F.min("place").alias("first"))
        for run in self.runs:
            fresh = fresh.join(self.read(run).hint("merge"), _KEY, "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(fresh))
        return self.read(*self.runs)


def _lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """Narrow rows of the lines that count: place and fingerprint of the document, line number, key."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("place"), F.xxhash64(text).alias("mark"), F.octet_length(text).alias("size"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    keyed = split.withColumn("key", F.translate(F.btrim("line", F.lit(SPACES)), _UPPER, _LOWER)).filter(F.char_length("key") >= min_chars)
    return keyed.select("place", "mark", "size", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), F.octet_length("key").alias("n"))


def dropped_lines(documents: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """place, mark, size and the sorted numbers of the lines to drop, for every document that loses lines."""
    spark = documents.sparkSession
    lines = _lines(documents, min_chars)
    cuts = documents.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = reduce(lambda a, b: a + b, [(F.col("place") > c).cast("int") for c in sorted(set(cuts))], F.lit(0))
    lines = saved(lines.withColumn("batch", batch), "lines")
    index, dropped = LineRuns(spark), []
    for number in range(len(set(cuts)) + 1):
        own = lines.filter(F.col("batch") == number).drop("batch")
        firsts = index.add(own)
        late = own.join(firsts, _KEY).filter(F.col("place") > F.col("first"))
        dropped.append(saved(late.select("place", "mark", "size", "pos"), "dropped"))
    together = reduce(DataFrame.unionByName, dropped)
    return together.groupBy("place", "mark", "size").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def dedup_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``row`` (all columns of the input, as a struct), ``kept_text``, ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased. A key of at least
    ``min_chars`` code points that several documents hold stays in the one with the smallest id only (all its lines
    there), in the others all lines with that key go.

    * NULL or empty text is one empty line. Text is split at ``\\n`` only; kept lines are unchanged.
    * Rows with the same id count as one document; rows with NULL id as one document after all others.
    * A text that loses all lines becomes empty. An empty table gives an empty result.
    * Lines are equal if 96 hash bits and the byte length of their keys agree.
    """
    docs = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
    )
    drops = dropped_lines(docs.select("doc_id", "text"), min_chars, batches)
    text = F.coalesce(F.col("text"), F.lit(""))
    joined = docs.withColumns({"place": F.coalesce("doc_id", F.lit(_LAST)), "mark": F.xxhash64(text), "size": F.octet_length(text)})
    joined = joined.join(drops, ["place", "mark", "size"], "left")
    lines = F.split(text, "\n", -1)
    # What stays are the stretches between dropped lines, so the work is linear in the number of lines.
    parts = joined.withColumn("lines", lines).withColumn("edges", F.expr("concat(array(-1), drops, array(size(lines)))"))
    kept = F.expr(
        "array_join(flatten(transform(sequence(0, size(edges) - 2), k -> slice(lines, edges[k] + 2, edges[k + 1] - edges[k] - 1))), '\n')"
    )
    return parts.select(
        "row", F.when(F.col("drops").isNull(), text).otherwise(kept).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), "doc_id",
    )


def line_digests(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(documents).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
