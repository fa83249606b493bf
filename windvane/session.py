"""Session-level helpers: size-checked broadcast and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 128 << 20


def _text_size() -> Column:
    return F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes (as text).

    The row limit stops the check early; a larger table is returned unhinted, so Spark
    shuffles the join (with AQE skew handling) instead.
    """
    rows, taken = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_text_size()), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and taken <= max_bytes else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; fall back only in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="windvane-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates of the rows taken in the same job."""
    seen = Observation()
    copy = materialize(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]))
    found = seen.get
    if not found:  # an empty plan may drop the observation
        found = copy.agg(*[m.alias(name) for name, m in metrics.items()]).first().asDict()
    return copy, found


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, reachable by every executor; it goes when the session's JVM ends."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, files = _hadoop(spark, folder)
    files.deleteOnExit(path)
    return folder


def _hadoop(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``scratch_folder``."""
    path, files = _hadoop(spark, folder)
    files.delete(path, True)


def stored(df: DataFrame, folder: str, *parts: str) -> DataFrame:
    """``df`` written once as Parquet (partitioned by ``parts``) and read back: unlike a checkpoint, later scans are pruned and filtered."""
    df.write.partitionBy(*parts).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_result(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``small_side`` of an aggregate: computed once, sized by the same job, and joined from its copy."""
    copy, size = measured(df, rows=F.count(F.lit(1)), bytes=F.coalesce(F.sum(_text_size()), F.lit(0)))
    return F.broadcast(copy) if size["rows"] <= max_rows and size["bytes"] <= max_bytes else copy


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
