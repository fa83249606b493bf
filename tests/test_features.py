"""Sensor expressions and window features against a pandas rendering of their definition."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windvane import config
from windvane.functions import sensors
from windvane.operators import features, harmonize


def test_number_text(spark):
    texts = ["1.5", "x", "nan", "", " 2 ", "inf", "-Infinity", "1e3", None, "1.5d", "2f", "0x1p3", "1.d ", "NA"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in rows.select("i", sensors.to_number("t").alias("n")).orderBy("i").collect()]
    assert got == [1.5, None, None, None, 2.0, math.inf, -math.inf, 1000.0, None, None, None, None, None, None]


def test_channel_mapping_averages_what_is_there(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 00:00:00", "10", "4", "1", None, "bad"), ("2024-01-01 00:10:00", "11", "5", None, None, None)],
        "time_stamp string, asset_id string, sensor_0_avg string, sensor_44 string, sensor_45 string, sensor_46 string",
    )
    first, second = harmonize.map_sensors(raw, "A").orderBy("time_stamp").collect()
    assert (first["farm_id"], first["asset_id"], first["amb_temp"], first["active_power"]) == ("A", "10", 4.0, 1.0)
    assert second["active_power"] is None and second["wind_speed"] is None
    assert list(first.asDict()) == [*config.IDENTITY_COLUMNS, *config.STANDARD_FEATURES]


def test_asset_defaults_and_bad_time(spark):
    raw = spark.createDataFrame([("2024-01-01",)], "time_stamp string")
    assert harmonize.map_sensors(raw, "B").first()["asset_id"] == "Unknown"
    bad = spark.createDataFrame([("not a time",)], "time_stamp string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        harmonize.map_sensors(bad, "B").collect()
    with pytest.raises(ValueError, match="time_stamp"):
        harmonize.map_sensors(spark.createDataFrame([("1",)], "asset_id string"), "A")


def test_units(spark):
    df = spark.createDataFrame([("A", 1000.0, 2.0), ("B", 1000.0, 2.0), ("C", 1000.0, 2.0)], "farm_id string, active_power double, gen_speed double")
    got = {r["farm_id"]: (r["active_power"], r["gen_speed"]) for r in harmonize.normalize_units(df).collect()}
    assert got["A"] == (6.0, 2.0) and got["B"] == (1000.0, 2.0)
    assert got["C"] == (1000.0, pytest.approx(2.0 * 60 / (2 * math.pi)))


def test_yaw_is_backfilled_only_where_a_history_has_none(spark):
    rows = [("A", 1, None, 350.0, 10.0), ("A", 1, None, 10.0, 40.0), ("A", 2, 5.0, 0.0, 90.0), ("A", 2, None, 0.0, 90.0), ("A", None, None, 0.0, 180.0)]
    df = spark.createDataFrame(rows, "farm_id string, event_id int, yaw_error double, wind_direction double, nacelle_direction double")
    got = sorted((r["event_id"] or 0, r["yaw_error"] if r["yaw_error"] is not None else -1) for r in harmonize.backfill_yaw_error(df).collect())
    assert got == [(0, 180.0), (1, 20.0), (1, 30.0), (2, -1), (2, 5.0)]


def test_physics_edges(spark):
    rows = [(1, 0.4, 10.0), (2, 0.5, 10.0), (3, None, 10.0), (4, 2.0, None), (5, -3.0, 10.0)]
    df = spark.createDataFrame(rows, "row_id int, wind_speed double, active_power double")
    got = {r["row_id"]: r["power_efficiency"] for r in features.physics_features(df).collect()}
    assert got == {1: 0.0, 2: 80.0, 3: 0.0, 4: 0.0, 5: 0.0}


@pytest.mark.parametrize("n", [35, 36, 37, 144, 145, 200])
def test_window_features_follow_row_based_definitions(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({c: rng.normal(50, 10, n).round(3) for c in config.STANDARD_FEATURES})
    pdf.loc[10, "gen_speed"] = np.nan
    pdf.loc[3:8, "yaw_error"] = 7.0
    pdf["time_stamp"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 10, unit="min")
    pdf.loc[20, "time_stamp"] = pdf.loc[19, "time_stamp"]
    rows = [
        (i, r.time_stamp.to_pydatetime(), *[None if np.isnan(getattr(r, c)) else float(getattr(r, c)) for c in config.STANDARD_FEATURES])
        for i, r in enumerate(pdf.itertuples())
    ]
    schema = "row_id long, time_stamp timestamp_ntz, " + ", ".join(f"{c} double" for c in config.STANDARD_FEATURES)
    df = spark.createDataFrame(rows, schema).withColumns({"farm_id": F.lit("A"), "event_id": F.lit(1)})
    got = features.derive_features(df).toPandas().sort_values("row_id").reset_index(drop=True)

    expected = pdf.copy()
    expected["temp_trend_24h"] = pdf["gearbox_oil_temp"].diff(144)
    expected["rpm_volatility"] = pdf["gen_speed"].rolling(36).std()
    for c in config.LAG_SIGNALS:
        for w in config.LAG_WINDOWS:
            expected[f"{c}_delta_{w}"] = pdf[c] - pdf[c].shift(w)
            expected[f"{c}_volatility_{w}"] = pdf[c].rolling(w).std()
    expected["temp_delta_gearbox"] = pdf["gearbox_oil_temp"] - pdf["amb_temp"]
    expected = expected.drop(columns="time_stamp").fillna(0)
    for column in expected:
        np.testing.assert_allclose(got[column], expected[column], rtol=1e-7, atol=1e-7, err_msg=column)


def test_histories_do_not_leak_into_each_other(spark):
    df = spark.range(400).select(
        F.lit("A").alias("farm_id"), (F.col("id") % 2).alias("event_id"), F.col("id").alias("row_id"),
        F.timestamp_micros(F.col("id") * 600_000_000).cast("timestamp_ntz").alias("time_stamp"), F.col("id").cast("double").alias("gearbox_oil_temp"),
    )
    out = features.temporal_features(df, wanted={"gearbox_oil_temp_delta_6", "temp_trend_24h"})
    assert out.filter("gearbox_oil_temp_delta_6 IS NULL").count() == 12
    assert {r[0] for r in out.select("gearbox_oil_temp_delta_6").distinct().collect()} == {None, 12.0}
    assert out.filter("temp_trend_24h = 288").count() == 112


def test_feature_map_from_dict():
    farms = config.FarmMap.from_dict({
        "farms": {"X": {"sensors": {"amb_temp": "s1", "hub_temp": ["s2", "s3"], "yaw_error": None}, "units": {"power": "kW", "speed": "RPM"}}},
        "standard_features": ["amb_temp", "hub_temp", "yaw_error"],
    })
    assert farms.required_channels("X") == ["time_stamp", "asset_id", "s1", "s2", "s3"]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_rolling_deviations_from_moments(spark, offset):
    """Gaps, constant stretches, leading NULLs, bursts, NaN and infinite values, at a large offset too."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=2000).round(3)
    x[300:420] = x[300]
    x[700:760] *= 1000
    x[900:1000] = 5.0 + 1e-2 * rng.normal(size=100).round(3)
    x = x + offset
    x[1500] = np.inf
    missing = rng.random(2000) < 0.01
    missing[:7] = True
    rows = [(i, None if m else float(v)) for i, (v, m) in enumerate(zip(x, missing))]
    rows[1600] = (1600, float("nan"))
    df = spark.createDataFrame(rows, "row_id long, gen_speed double").selectExpr("'A' AS farm_id", "1 AS event_id", "timestamp_ntz'2024-01-01' AS time_stamp", "*")
    columns = {f"d{w}": ("gen_speed", w) for w in (2, 6, 24, 36)}
    out = features.rolling_deviations(df, columns, ["farm_id"], ["row_id"]).toPandas().sort_values("row_id").reset_index(drop=True)
    values = [np.nan if v is None else v for _, v in rows]
    odd = np.array([v is not None and not np.isfinite(v) for _, v in rows])
    for w in (2, 6, 24, 36):
        exact = np.array([float(np.std(np.array(values[i - w + 1 : i + 1]) - offset, ddof=1)) if i >= w - 1 else np.nan for i in range(2000)])
        got = out[f"d{w}"].to_numpy(float)
        whole = ~np.isnan(exact)
        spread = np.nanmax(np.where(np.isfinite(values), values, np.nan)) - np.nanmin(values)
        wrong = whole & ~(np.abs(got - exact) <= 1e-6 * np.abs(exact) + 1e-7 * spread + 1e-12)
        assert not wrong.any(), (w, np.flatnonzero(wrong), got[wrong], exact[wrong], spread)
        assert np.isnan(got[~whole]).all()
        assert (got[300 + w : 420][whole[300 + w : 420]] == 0).all()
        null = out[f"d{w}"].isna() & ~pd.Series([any(odd[max(0, i - w + 1) : i + 1]) for i in range(2000)])
        assert null.sum() > 0


def test_window_tasks_hold_few_chunks(spark, monkeypatch):
    """Windows are spread by rows, not by the bytes that are shuffled before the rows grow."""
    monkeypatch.setattr(features, "WINDOW_ROWS", 100)
    df = spark.range(4000).select(
        F.col("id").alias("row_id"), F.lit("A").alias("farm_id"), (F.col("id") % 2).alias("event_id"),
        F.timestamp_micros(F.col("id") * 600_000_000).cast("timestamp_ntz").alias("time_stamp"), (F.col("id") % 13).cast("double").alias("gearbox_oil_temp"),
    )
    cut = features.temporal_features(df, rows_per_chunk=100)
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 600
    trend = "`gearbox_oil_temp` - lag(`gearbox_oil_temp`, 144) OVER (PARTITION BY event_id ORDER BY time_stamp)"
    plain = {r["row_id"]: r["v"] for r in df.selectExpr("row_id", f"{trend} AS v").collect()}
    assert {r["row_id"]: r["temp_trend_24h"] for r in cut.collect()} == plain
