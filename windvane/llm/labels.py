"""Labelled texts for the classifiers, and the columns that their results share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windvane.llm.common import maybe_in, saved, text_rows
from windvane.llm.language_id import held_out

FOLDS, HELD_OUT = 3, 1


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, max_bytes: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """text, label and part (each 0 or 1) of about ``max_rows`` documents of each label, at most, none held out; and all labels' totals.

    The bounds are the classifiers' documented parameters (``max_bytes`` of text per label, if given); a label with fewer rows gives all of them. Rows are chosen by
    a hash of their id, so reruns agree. Of several labels of an id the largest counts; NULL ids and NULL labels don't.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id", FOLDS, HELD_OUT)).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = saved(known, "labels")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") == 1, max_rows / max(totals.get(1, 1), 1)).otherwise(max_rows / max(totals.get(0, 1), 1))
    chosen = known.filter(draw < share).withColumn("part", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)).cast("int"))
    chosen = saved(chosen.withColumnRenamed("doc_id", "_id"), "chosen")
    likely = maybe_in(text_rows(documents), "doc_id", chosen, "_id")
    found = saved(likely.join(chosen, F.col("doc_id") == F.col("_id")).select("text", "label", "part"), "labelled")
    if max_bytes is None:
        return found, totals
    # A few ten thousand rows: sizes and hashes only are put in order.
    upto = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("label").orderBy("mark", "part").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("mark", F.xxhash64("text")).withColumn("upto", upto).filter(F.col("upto") <= max_bytes).select("text", "label", "part"), totals


def judged(scored: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scored.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
