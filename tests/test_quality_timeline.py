"""Quality reports, feature selection and event timelines."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from windvane import config, session
from windvane.operators import ordered_chunks, quality, selection, timeline
from windvane.sources import fleet

T0 = datetime(2024, 6, 1)


def labelled(spark):
    rows = [
        ("A", "1", 1, 0, "normal", False, 0.0, 1.0, None), ("A", "1", 1, 5, "excluded_buffer", True, None, 2.0, 4.0),
        ("A", "2", 2, 4, "event_occurring", False, 1.0, 3.0, None), ("B", "1", 3, 0, None, False, 0.0, 4.0, 0.0),
    ]
    schema = ("farm_id string, asset_id string, event_id long, state_label int, state_name string, is_excluded_buffer boolean, "
              "target double, wind_speed double, hub_temp double")
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({"time_stamp": F.lit(T0).cast("timestamp_ntz"), "event_label": F.lit("anomaly"),
                           "event_start": F.lit(T0).cast("timestamp_ntz"), "event_end": F.lit(T0).cast("timestamp_ntz")})


def test_reports(spark):
    df = labelled(spark)
    missing = {r["column"]: r["missing_fraction"] for r in quality.missingness(df).collect()}
    assert (missing["hub_temp"], missing["target"], missing["wind_speed"]) == (0.5, 0.25, 0.0)
    states = {r["state_name"]: (r["count"], r["fraction"]) for r in quality.distribution(df, "state_name").collect()}
    assert states[None] == (1, 0.25) and len(states) == 4
    farms = {r["farm_id"]: r.asDict() for r in quality.farm_summary(df).collect()}
    assert farms["A"] == {"farm_id": "A", "n_rows": 3, "n_assets": 2, "positive_target_rows": 1.0, "excluded_buffer_rows": 1}
    summary = quality.dataset_summary(df).first()
    assert (summary["rows"], summary["unique_farms"], summary["unique_turbines"], summary["unique_events"]) == (4, 2, 2, 3)
    assert summary["positive_rate"] == pytest.approx(1 / 3)
    assert quality.dataset_profile(df).first()["min_time"] == T0
    assert quality.target_counts(df).first().asDict() == {"positives": 1, "negatives": 2, "missing": 1}


def test_label_rules(spark):
    df = labelled(spark)
    assert {r["rule"]: r["violations"] for r in quality.label_validation(df).collect()} == {"unknown_state": 0, "non_binary_target": 0}
    broken = df.withColumns({"state_label": F.lit(6), "target": F.when(F.col("is_excluded_buffer"), 7.0).otherwise(0.5)})
    assert {r["rule"]: r["violations"] for r in quality.label_validation(broken).collect()} == {"unknown_state": 4, "non_binary_target": 3}


def test_coverage_and_schema(spark):
    groups = {"standard": ["wind_speed", "hub_temp", "pitch_angle"], "meta": ["farm_id"]}
    rows = {r["column"]: r for r in quality.feature_coverage(labelled(spark), groups).collect()}
    assert (rows["hub_temp"]["non_null"], rows["hub_temp"]["non_zero"]) == (2, 1)
    assert not rows["pitch_angle"]["is_present"]
    table = {r["category"]: r.asDict() for r in quality.schema_validation(labelled(spark), groups).collect()}
    assert table["standard"] == {"category": "standard", "expected": 3, "present": 2, "missing": 1, "with_values": 2}


def test_correlation(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    x, z = y + rng.normal(size=300), -y + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(t)) for a, b, t in zip(x, z, y)], "x double, z double, flat double, target double")
    rows = quality.target_correlation(df).collect()
    assert [r["feature"] for r in rows] == ["x", "z", "flat"] and rows[2]["correlation"] is None
    assert rows[0]["correlation"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_class_weights(spark):
    df = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 2, "target double")
    rows = {r["class"]: r for r in quality.class_weights(df).collect()}
    assert (rows[1]["balanced_weight"], rows[1]["boosting_weight"]) == (2.0, 3.0)
    assert rows[0]["balanced_weight"] == pytest.approx(8 / 12)
    one = {r["class"]: r for r in quality.class_weights(df.filter("target = 0")).collect()}
    assert one[1]["boosting_weight"] == 1.0


def test_feature_selection(spark):
    df = labelled(spark)
    assert selection.feature_columns(df) == ["wind_speed", "hub_temp"]
    assert selection.feature_columns(df, include=["hub_temp", "target"]) == ["hub_temp"]
    assert selection.feature_columns(df, extra_excluded=["hub_temp"], subset="all") == ["wind_speed"]
    assert selection.feature_columns(df.withColumn("note", F.lit("x")), numeric_only=False) == ["wind_speed", "hub_temp", "note"]
    assert selection.feature_columns(df, include=["nothing"], require_non_empty=False) == []
    with pytest.raises(ValueError, match="no feature"):
        selection.feature_columns(df, include=["nothing"])
    with pytest.raises(ValueError, match="subset"):
        selection.feature_columns(df, subset="vibration")
    with pytest.raises(ValueError, match="state_label"):
        selection.check_no_leakage(["hub_temp", "state_label"])
    assert selection.prepare_xy(df).columns == ["wind_speed", "hub_temp", "target"]
    assert selection.prepare_xy(df, drop_cols=["farm_id"]).columns[0] == "asset_id"
    assert selection.feature_matrix(df).columns == ["wind_speed", "hub_temp"]
    assert selection.selection_summary(df).filter("is_feature").count() == 2
    with pytest.raises(ValueError, match="missing"):
        selection.prepare_xy(df.drop("target"))


def telemetry(spark):
    rows = []
    for event, asset, hours in ((1, "t1", range(-200, 40)), (2, "t2", range(-3, 3))):
        for h in hours:
            rows.append((T0 + timedelta(hours=h), "A", asset, event, "anomaly a/b", T0, T0 + timedelta(hours=9), float(h * h % 17), 5.0, len(rows)))
    schema = ("time_stamp timestamp_ntz, farm_id string, asset_id string, event_id long, event_label string, event_start timestamp_ntz, "
              "event_end timestamp_ntz, vibration_raw double, nacelle_temp double, row_id long")
    return spark.createDataFrame(rows, schema)


def test_timeline(spark):
    out = timeline.event_timeline(telemetry(spark), signals=["vibration_raw", "nacelle_temp"]).toPandas()
    first = out[out["event_id"] == 1].sort_values("time_stamp")
    assert len(first) == 193 and first["hours_from_event_start"].tolist() == list(range(-168, 25))
    x = first["vibration_raw"]
    np.testing.assert_allclose(first["vibration_raw_z"], (x - x.mean()) / x.std(), atol=1e-9)
    assert (out["nacelle_temp_z"] == 0).all() and (out["event_id"] == 2).sum() == 6


@pytest.mark.parametrize("broadcast", [True, False])
def test_timeline_with_separate_events(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(timeline, "small_side", lambda df: df)
    df = telemetry(spark)
    events = df.select(*timeline.INDEX_COLUMNS).distinct()
    second = events.filter("event_id = 1").withColumns({"event_id": F.lit(3).cast("long"), "event_start": F.col("event_start") + F.expr("interval 30 hours")})
    absent = events.filter("event_id = 2").withColumns({"event_id": F.lit(4).cast("long"), "event_start": F.col("event_start") + F.expr("interval 90 days")})
    out = timeline.event_timeline(df, events.union(second).union(absent), ["vibration_raw"]).toPandas()
    assert out.groupby("event_id").size().to_dict() == {1: 193, 2: 6, 3: 168 + 10}
    same = timeline.event_timeline(df, signals=["vibration_raw"]).toPandas()
    a = out[out["event_id"] == 1].sort_values("time_stamp")["vibration_raw_z"].to_numpy()
    np.testing.assert_allclose(a, same[same["event_id"] == 1].sort_values("time_stamp")["vibration_raw_z"].to_numpy(), atol=1e-9)


def test_event_index(spark):
    df = telemetry(spark).withColumn("event_start", F.when(F.col("event_id") == 1, F.col("event_start")))
    rows = timeline.sorted_event_index(df.withColumn("source", F.lit("A_event_1.parquet")), "source").collect()
    assert [r["file_name"] for r in rows] == ["A_event_1__farm_A_turbine_t1_event_1_anomaly_a_b.png"]


def test_prediction_timeline(spark):
    df = telemetry(spark).withColumn("y_proba", F.col("row_id") / 300)
    out = timeline.prediction_timeline(df)
    assert out.filter("y_pred != int(y_proba >= 0.78)").count() == 0 and out.count() == 199
    with pytest.raises(KeyError, match="y_proba"):
        timeline.prediction_timeline(df.drop("y_proba"))


@pytest.mark.parametrize("rows_per_chunk", [7, 10**6])
def test_failure_bands(spark, rows_per_chunk):
    hits = [0, 1, 1, 0, 0, 1, None, 1, 1, 1] * 3
    rows = [("A", "13", T0 + timedelta(minutes=i), i, None if h is None else float(h)) for i, h in enumerate(hits)]
    df = spark.createDataFrame(rows, "farm_id string, asset_id string, time_stamp timestamp_ntz, row_id long, target double")
    out = timeline.failure_bands(df, asset_id="13", rows_per_chunk=rows_per_chunk).orderBy("band_start").collect()
    assert [r["n_rows"] for r in out] == [2, 1, 3] * 3
    assert out[0]["band_start"] == T0 + timedelta(minutes=1) and out[0]["band_end"] == T0 + timedelta(minutes=2)
    assert timeline.failure_bands(df, asset_id="14").count() == 0


def test_small_side_only_hints_small_tables(spark):
    df = spark.range(100)
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(session.small_side(df, 100)) and not hinted(session.small_side(df, 99))


def test_vocabulary():
    assert config.state_code("pre_0_24h") == 3 and config.state_code(5) == 5
    assert len(config.TEMPORAL_FEATURES) == 16 and len(config.STANDARD_FEATURES) == 13
    with pytest.raises(ValueError, match="unknown model"):
        config.model_params("svm")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "amb_temp double")
    assert quality.missingness(df).first()["missing_fraction"] == 0.5
    row = quality.feature_coverage(df, {"x": ["amb_temp"]}).first()
    assert (row["non_null"], row["non_zero"]) == (2, 2)


def test_events_listed_twice_count_once(spark):
    harmonized, events = fleet.harmonized(spark, "/root/testdata/sf0.001"), fleet.faults(spark, "/root/testdata/sf0.001")
    once = timeline.event_timeline(harmonized, events, ["nacelle_temp"], keep=("row_id",))
    twice = timeline.event_timeline(harmonized, events.unionByName(events), ["nacelle_temp"], keep=("row_id",))
    assert once.count() > 0 and once.exceptAll(twice).count() == 0 == twice.exceptAll(once).count()


@pytest.mark.parametrize("gathered", [1 << 16, 20])
def test_quantiles_of_tied_values(spark, monkeypatch, gathered):
    """A third of a group is one value; another group has a value once; cells and gathered groups agree with numpy."""
    monkeypatch.setattr(ordered_chunks, "GATHER_ROWS", gathered)
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in np.where(rng.random(900) < 0.34, 4.25, rng.normal(size=900).round(2))] + [("b", 1.5)] + [("c", float(v)) for v in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows + [("a", None), ("d", None), (None, 2.0), (None, 6.0)], "k string, v double")
    got = {(r["k"], r["quantile"]): r["value"] for r in quality.exact_quantiles(df, ["k"], "v", (0.0, 0.1, 0.5, 0.9, 1.0)).collect()}
    values = {}
    for k, v in rows + [(None, 2.0), (None, 6.0)]:
        values.setdefault(k, []).append(v)
    assert got == {(k, q): pytest.approx(float(np.quantile(v, q))) for k, v in values.items() for q in (0.0, 0.1, 0.5, 0.9, 1.0)}
