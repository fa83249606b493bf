"""A turbine fleet seen through the ``events`` table, so every operator has data to run on.

Users are folded onto fifteen turbines of three farms; sensor channels are arithmetic on
the event's value, its counter ``k`` and its id. Gaps, bad text and a turbine without yaw
sensor are part of the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane import config
from windvane.operators.features import WINDOW_ROWS, derive_features
from windvane.operators.harmonize import normalize_units
from windvane.operators.labeling import label_states

TURBINES = 15
FAULT_FROM = "2024-01-12"
FAULT_HOURS = 36


_FARM = "CASE turbine % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"

# Sensor features in farm units, as arithmetic on the event.
_SENSORS = {
    "amb_temp": "double(row_id % 40 - 5)",
    "wind_speed": "CASE WHEN row_id % 97 <> 0 THEN k / 4 END",
    "pitch_angle": "double(bigint(k) % 30)",
    "active_power": "value",
    "gen_speed": "CASE WHEN row_id % 97 <> 0 THEN k END",
    "gearbox_oil_temp": "CASE WHEN row_id % 97 <> 0 THEN 40 + value / 10 END",
    "transformer_temp": "35 + k / 3",
    "nacelle_temp": "20 + k / 5",
    "hub_temp": "double(row_id % 17 + 15)",
    "yaw_error": "CASE WHEN turbine <> 3 THEN double((row_id * 29) % 90) END",
    "vibration_raw": "value - 20",
    "hydraulic_temp": "CASE WHEN turbine % 3 <> 1 THEN 30 + value / 25 END",
    "generator_temp": "CASE WHEN row_id % 7 <> 0 THEN ((50 + value / 8) + (48 + k / 6)) / 2 ELSE 48 + k / 6 END",
    "wind_direction": "(row_id * 37) % 360",
    "nacelle_direction": "(row_id * 53) % 360",
}


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS row_id", "ts AS time_stamp", f"user_id % {TURBINES} AS turbine", "event_type", "value",
        "double(get_json_object(props, '$.k')) AS k",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor features in farm units, before unit normalization."""
    return _base(spark, sf_dir).selectExpr(
        "time_stamp", f"{_FARM} AS farm_id", "string(turbine) AS asset_id", "turbine AS event_id", "row_id",
        *[f"{expr} AS {name}" for name, expr in _SENSORS.items()],
    )


def harmonized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_units(telemetry(spark, sf_dir)).drop("wind_direction", "nacelle_direction")


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per turbine: it starts at the first error on or after the fault date."""
    errors = _base(spark, sf_dir).filter(f"event_type = 'error' AND time_stamp >= timestamp_ntz'{FAULT_FROM}'")
    return errors.groupBy("turbine").agg(F.min("time_stamp").alias("event_start")).selectExpr(
        f"{_FARM} AS farm_id", "string(turbine) AS asset_id", "turbine AS event_id",
        "CASE WHEN turbine % 3 <> 0 THEN 'anomaly' ELSE 'normal' END AS event_label",
        "event_start", f"event_start + interval {FAULT_HOURS} hours AS event_end",
    )


def processed(spark: SparkSession, sf_dir: str, buffer_hours: float = 0.0, rows_per_chunk: int = WINDOW_ROWS) -> DataFrame:
    featured = derive_features(harmonized(spark, sf_dir), rows_per_chunk=rows_per_chunk)
    return label_states(
        featured, faults(spark, sf_dir), buffer_before_hours=buffer_hours, buffer_after_hours=buffer_hours
    )


def labelled(spark: SparkSession, sf_dir: str, buffer_hours: float = 6.0) -> DataFrame:
    """State labels on harmonized rows, without the window features."""
    return label_states(
        harmonized(spark, sf_dir), faults(spark, sf_dir), buffer_before_hours=buffer_hours, buffer_after_hours=buffer_hours
    )


_SCORE = "0.7D * (double((row_id * 7919) % 1000) / 1000) + 0.3D * int(event_type = 'error')"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and a deterministic score with many ties."""
    return _base(spark, sf_dir).selectExpr("row_id", "int(event_type = 'error') AS y_true", f"{_SCORE} AS y_prob")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same score as a prediction table by turbine and time."""
    return _base(spark, sf_dir).selectExpr(
        "time_stamp", f"{_FARM} AS farm_id", "string(turbine) AS asset_id", f"{_SCORE} AS y_proba"
    )


def raw_channels(spark: SparkSession, sf_dir: str, farm: str) -> DataFrame:
    """Text channels of one farm under its own channel names, as a raw file holds them.

    Channel ``i`` of a feature is its base value plus ``i``; averaged channels drop out now
    and then, single channels sometimes hold text that is not a number.
    """
    columns = []
    for place, feature in enumerate(config.STANDARD_FEATURES):
        channels = config.FARM_CHANNELS[farm][feature]
        for i, channel in enumerate(channels):
            text = f"string(value + k * {place} + {i})"
            gaps = f"CASE WHEN (row_id + {i}) % 7 <> 0 THEN {text} END"
            noise = f"CASE WHEN row_id % 11 = 0 THEN 'n/a' ELSE {text} END"
            columns.append(f"{gaps if len(channels) > 1 else noise} AS {channel}")
    own = _base(spark, sf_dir).filter(f"{_FARM} = '{farm}'")
    return own.selectExpr("string(time_stamp) AS time_stamp", "string(turbine) AS asset_id", "row_id", *columns)
