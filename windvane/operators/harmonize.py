"""Farm-specific channels to the shared feature schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane import config
from windvane.config import FarmMap
from windvane.functions import sensors
from windvane.session import require_columns, small_result


def map_sensors(raw: DataFrame, farm: str, farms: FarmMap = FarmMap(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Identity columns plus one DOUBLE per standard feature; absent channels give NULL."""
    require_columns(raw, "time_stamp")
    available = set(raw.columns)
    asset = F.coalesce(F.col("asset_id").cast("string"), F.lit("nan")) if "asset_id" in available else F.lit("Unknown")
    present = {f: [r for r in farms.channels[farm].get(f, ()) if r in available] for f in farms.features}
    channels = list(dict.fromkeys(r for refs in present.values() for r in refs))
    # Parse every channel once, in its own projection; the means below reuse the numbers.
    numbers = raw.select(
        F.col("time_stamp").cast("timestamp_ntz").alias("time_stamp"),
        F.lit(farm).alias("farm_id"),
        asset.alias("asset_id"),
        *[sensors.to_number(r).alias(f"_n_{r}") for r in channels],
        *keep,
    )
    means = [f"{sensors.mean_sql([f'_n_{r}' for r in refs])} AS {f}" for f, refs in present.items()]
    return numbers.selectExpr(*config.IDENTITY_COLUMNS, *means, *keep)


def normalize_units(df: DataFrame, farms: FarmMap = FarmMap()) -> DataFrame:
    """Bring power to kW and generator speed to rpm according to each farm's units."""
    changes = {}
    watt_hour = [f for f, u in farms.units.items() if u["power"] == "Wh"]
    radians = [f for f, u in farms.units.items() if u["speed"] == "rad/s"]
    if watt_hour and "active_power" in df.columns:
        unit = F.when(F.col("farm_id").isin(watt_hour), "Wh")
        changes["active_power"] = sensors.normalized_power(F.col("active_power"), unit)
    if radians and "gen_speed" in df.columns:
        unit = F.when(F.col("farm_id").isin(radians), "rad/s")
        changes["gen_speed"] = sensors.normalized_speed(F.col("gen_speed"), unit)
    return df.withColumns(changes)


def union_farms(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def backfill_yaw_error(df: DataFrame, keys: list[str] = ["farm_id", "event_id"]) -> DataFrame:
    """Derive yaw error from wind and nacelle direction where a whole history has none.

    "Has none" is one small row per history (an aggregate with map-side combine), joined
    back; no history is gathered in one task.
    """
    require_columns(df, "wind_direction", "nacelle_direction", *keys)
    derived = sensors.circular_distance(F.col("wind_direction"), F.col("nacelle_direction")).cast("double")
    if "yaw_error" not in df.columns:
        return df.withColumn("yaw_error", derived)
    absent = (
        df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys])
        .agg(F.count("yaw_error").alias("_present"))
        .filter(F.col("_present") == 0)
    )
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    joined = df.join(small_result(absent), condition, "left")
    filled = F.when(F.col("_present") == 0, derived).otherwise(F.col("yaw_error"))
    return joined.withColumn("yaw_error", filled).select(*df.columns)


def feature_map_table(spark, farms: FarmMap = FarmMap()) -> DataFrame:
    """The mapping as data: farm_id, feature, channel, pos (1-based), one row per channel."""
    rows = [
        (farm, feature, channel, pos)
        for farm, features in farms.channels.items()
        for feature, refs in features.items()
        for pos, channel in enumerate(refs, 1)
    ]
    return spark.createDataFrame(rows, "farm_id string, feature string, channel string, pos int")
