"""Batch preprocessing: raw farm folders to labelled feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windvane.config import FarmMap
from windvane.operators.features import WINDOW_ROWS, derive_features
from windvane.operators.harmonize import normalize_units
from windvane.operators.labeling import label_states
from windvane.session import remove_folder, scratch_folder, stored
from windvane.sources import readers, writers


def build_processed(
    harmonized: DataFrame, events: DataFrame, *,
    buffer_before_hours: float = 0.0, buffer_after_hours: float = 0.0,
    event_order: str | None = None, rows_per_chunk: int = WINDOW_ROWS,
) -> DataFrame:
    """Features and labels of unit-normalized telemetry (needs event_id and row_id)."""
    featured = derive_features(harmonized, rows_per_chunk=rows_per_chunk)
    return label_states(
        featured, events, buffer_before_hours=buffer_before_hours,
        buffer_after_hours=buffer_after_hours, order=event_order,
    )


def preprocess(
    spark: SparkSession, raw_root: str, processed_path: str, *,
    master_path: str | None = None, farms: FarmMap = FarmMap(), overwrite: bool = False,
    buffer_before_hours: float = 0.0, buffer_after_hours: float = 0.0, checks: dict[str, int] | None = None,
) -> str:
    """Read every farm, harmonize, derive, label and write; optionally consolidate.

    The harmonized table is written once as Parquet: it is a fraction of the raw text, it fixes
    the scan-order row ids, and the passes that size the histories read only the columns they
    count. The copy goes when the run ends. ``checks`` receives the validation counts that the write takes.
    """
    if master_path is not None:
        writers.check_master_path(processed_path, master_path)
    folder = scratch_folder(spark, "harmonized")
    try:
        harmonized = stored(normalize_units(readers.read_farms(spark, raw_root, farms), farms), folder)
        processed = build_processed(
            harmonized, readers.read_event_info(spark, raw_root, farms),
            buffer_before_hours=buffer_before_hours, buffer_after_hours=buffer_after_hours, event_order="event_seq",
        )
        counts = writers.write_checked(processed, processed_path, overwrite=overwrite)
        if checks is not None:
            checks.update(counts)
    finally:
        remove_folder(spark, folder)
    if master_path is not None:
        writers.create_master(spark, processed_path, master_path, overwrite=overwrite)
    return processed_path
