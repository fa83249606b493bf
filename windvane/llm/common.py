"""Shared helpers: tables kept in the shared folder, global prefix sums, safe column access."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane.session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"  # the characters [\x20\x09-\x0D]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor reaches; it goes when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a lineage cut that can be pruned."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def text_rows(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", *keep: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns, whatever their names, cannot clash."""
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *[F.col(c) for c in keep])


def text_column(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    """A string column of a batch with NULL as the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null("") if column.null_count else column


def prefix_sums(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Add ``before_<value>`` for each value: its sum over all rows that come earlier in ``order`` (NULLs last).

    Rows are range-partitioned (a row number breaks ties, so equal keys do not meet in one task), summed inside
    partitions, and shifted by the totals of the partitions before; only one row per partition reaches the driver.
    Values must be non-negative longs.
    """
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col("_tie")]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema if f.name != "_tie")
    added = ", ".join(f"before_{v} long" for v in values)

    def running(batches):
        totals = dict.fromkeys(values, 0)
        for batch in batches:
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_tie"]
            names = [n for n in batch.schema.names if n != "_tie"]
            for v in values:
                own = batch.column(batch.schema.get_field_index(v)).cast(pa.int64())
                columns.append(pc.add(pc.subtract(pc.cumulative_sum(own), own), totals[v]))
                names.append(f"before_{v}")
                totals[v] += pc.sum(own).as_py() or 0
            yield pa.RecordBatch.from_arrays(columns, names=names)

    local = saved(placed.mapInArrow(running, f"{types}, {added}"), "prefix")
    sums = sorted(local.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values]).collect(), key=lambda r: r["_part"])
    shifts, total = [], [0] * len(values)
    for row in sums:
        shifts.append((row["_part"], *total))
        total = [t + row[v] for t, v in zip(total, values)]
    layout = df.sparkSession.createDataFrame(shifts, "_part int, " + ", ".join(f"_shift_{v} long" for v in values))
    shifted = local.join(F.broadcast(layout), "_part")  # one row per partition
    return shifted.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_shift_{v}") for v in values}).drop("_part", *[f"_shift_{v}" for v in values])


BITMAP_BITS = 1 << 24


def bitmap(keys: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """A bitmap of fixed size (2 MB) over long keys, hashed here if they aren't: what is not in it is not among the keys."""
    bit = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(BITMAP_BITS))
    words = keys.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, int(bit & 63))").alias("set"))
    found = words.groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["set"].to_numpy(np.int64)
    return out.view(np.uint64)


def maybe_in(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose long column may be among ``keys``: what a join would drop anyway, mostly dropped before its shuffle."""
    bits = df.sparkSession.sparkContext.broadcast(bitmap(keys, key))

    @F.pandas_udf("boolean")
    def present(bit: pd.Series) -> pd.Series:
        at = bit.to_numpy(np.uint64)
        return pd.Series((bits.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool))

    return df.filter(present(F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))))


def content_key(text: str = "text") -> list:
    """mark and size of a text: with the id, they name a row's content the same way in every scan."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("mark"), F.octet_length(whole).alias("size")]


def texts_of(documents: DataFrame, needed: DataFrame, *carry: str) -> DataFrame:
    """Whole texts for the rows named by doc_id, mark and size in ``needed`` (distinct, with columns to carry)."""
    keyed = documents.select("doc_id", "text", *content_key())
    likely = maybe_in(keyed, "mark", needed, "mark")
    named = needed.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("size").alias("_size"), *carry)
    found = likely.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")) & (F.col("size") == F.col("_size")))
    return found.drop("_id", "_mark", "_size")
