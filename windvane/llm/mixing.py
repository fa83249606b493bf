"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow: its documents in a fixed shuffled order, then again, up to ``EPOCHS`` times. A copy of a
document starts at the source's words before it and finishes behind its own, both divided by the source's weight:
virtual times. Copies are globally sorted by virtual finish time and the sequence is truncated where the budget is
spent. A flow that runs out leaves its share to the others by weight, so the clock at that moment is the level of a
water-filling over the sources; the copy that each source has in service then is cut at a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import prefix_sums, saved
from windvane.llm.words import word_counts

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 20240607


def sized(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """doc_id, source and number of words of every row, with a row number and a shuffled place."""

    def count(batches):
        import pyarrow as pa

        from windvane.llm.common import text_column as text_of

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(word_counts(text_of(batch)), pa.int64())], names=["doc_id", "source", "size"]
            )

    narrow = documents.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).cast("string").alias("text")
    )
    counted = narrow.mapInArrow(count, "doc_id long, source string, size long")
    return saved(counted.select("*", F.xxhash64(F.lit(SEED), "doc_id").alias("place"), F.monotonically_increasing_id().alias("row")), "sizes")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, float, int]:
    """Sources with size, weight, target and the words of all sources before; the final virtual time; the budget.

    Sources take the weights in turn, in code-point order, NULL last. Targets share the budget (all words) by weight,
    stop at ``epochs`` times the source's size, and what is over is shared again among the rest.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = prefix_sums(sources, ["source"], ["one", "source_size"])
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = ranked.withColumn("weight", turn[F.pmod("before_one", F.lit(len(weights))).cast("int")])
    ranked = saved(ranked.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap") / F.col("weight")), "sources")
    totals = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, all_weight = totals[0] or 0, totals[1] or 1
    # Sources fill up in the order of cap over weight; the level is where the next one would no longer fill.
    filling = prefix_sums(ranked.select("ratio", "cap", "weight"), ["ratio"], ["cap", "weight"])
    level = (F.lit(float(budget)) - F.col("before_cap")) / (F.lit(float(all_weight)) - F.col("before_weight"))
    clock = filling.withColumn("level", level).filter(F.col("level") <= F.col("ratio")).agg(F.min_by("level", "ratio"), F.max("level")).first()[0] or 0.0
    targets = ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(clock)))
    return targets.select("source", "source_size", "weight", "target", F.col("before_source_size").alias("base")), clock, budget


def mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The sources with targets, and the mix: (row, copy, taken, at), where ``at`` is the copy's first word in the mix."""
    sources, clock, budget = source_targets(sizes, weights, epochs)
    queued = prefix_sums(sizes, ["source", "place", "doc_id"], ["size"])
    joined = queued.join(sources, queued["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn(
        "start", F.col("before_size") - F.col("base") + F.col("copy") * F.col("source_size")
    )
    copies = copies.withColumn("finish", (F.col("start") + F.col("size")) / F.col("weight"))
    served = F.least(F.col("size"), F.round(F.col("target")).cast("long") - F.col("start"))
    taken = copies.withColumn("taken", served).filter((F.col("start") / F.col("weight") < F.lit(clock)) & (F.col("taken") > 0))
    ordered = prefix_sums(taken.select("row", "copy", "finish", "taken"), ["finish", "row", "copy"], ["taken"])
    return sources, ordered.filter(F.col("before_taken") < budget).select("row", "copy", "taken", F.col("before_taken").alias("at"))


def mixed_documents(documents: DataFrame, **columns) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words in the mix, repeats counted).

    * NULL text has size 0; NULL source is a source of its own, the last. NULL ids are allowed.
    * Rows with the same id are separate documents. Ties in the shuffle are broken by id, then by row.
    * Targets are met to a word; no document is taken more than three times. Reruns agree, since the order depends on
      ids only (rows equal in source and id may swap).
    * An empty table, or one without words, gives targets and takes of 0.
    """
    sizes = sized(documents, **columns)
    sources, ordered = mix(sizes)
    taken = ordered.groupBy("row").agg(F.sum("taken").alias("taken"))
    found = sizes.join(taken, "row", "left")
    found = found.join(sources, found["source"].eqNullSafe(sources["source"]))
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
