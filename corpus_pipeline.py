"""A training corpus from the documents table: language, repeated lines, near copies, benchmark leaks, source mix.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's input. All but the last
return the columns of the input; rows are identified by id and text, so NULL ids and repeated rows are allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane.llm import decontaminate, language_id, line_dedup, minhash_dedup, mixing
from windvane.llm.common import content_key, maybe_in, saved, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or text) go, since they have no language; a missing lang is filled in.

    If there is nothing to learn from (no lang outside the held-out fifth), no other document goes and langs stay as they are.
    """
    found = language_id.predicted(docs, docs.columns).filter("letter")
    return found.select(*[F.coalesce("row.lang", F.nullif("lang_pred", F.lit("und"))).alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the text; n_chars follows."""
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return line_dedup.dedup_lines(docs).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _rows(docs: DataFrame) -> DataFrame:
    """``row`` (all columns, as a struct, so that none can clash) and what names its content: doc_id, mark, size."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *content_key())


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _without(rows: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows whose id and text are not (``left_semi``: are) among the keys (doc_id, mark, size)."""
    named = keys.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("size").alias("_size"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")) & (F.col("size") == F.col("_size"))
    return rows.join(named, same, how)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one document stays, that with the smallest id (NULL last; then by text); of rows that repeat id and text, one."""
    groups = saved(minhash_dedup.near_groups(docs), "near")
    key = ["doc_id", "mark", "size"]
    linked = groups.filter("comp IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *key)).alias("first")
    staying = saved(linked.groupBy("comp").agg(first).select("first.doc_id", "first.mark", "first.size"), "staying")
    # By what names a row, not by component: a large one is spread.
    going = saved(_without(linked.select(*key).distinct(), staying), "going")
    repeated = saved(_without(groups.select(*key), going).groupBy(*key).count().filter("count > 1").select(*key), "repeated")
    rows = _rows(docs)
    single = _without(rows, going.unionByName(repeated))
    again = _without(maybe_in(rows, "mark", repeated, "mark"), repeated, "left_semi").dropDuplicates(key)
    return _unpacked(single.unionByName(again), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    leaks = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(_without(_rows(docs), leaks.select("doc_id", "mark", "size").distinct()), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: doc_id, size, source_size, target, taken."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
]

# The language model, the signatures and the shuffle of the mix have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""

    def step(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        folder = shared_folder(spark, name)
        function(spark, docs, sf_dir).write.parquet(folder)
        return spark.read.parquet(folder)

    return reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
