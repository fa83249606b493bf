"""State labels at their boundaries, targets and their checks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windvane import config
from windvane.functions import states
from windvane.operators import labeling

START, END = datetime(2024, 3, 10, 12), datetime(2024, 3, 12)
EVENT_SCHEMA = "farm_id string, event_id long, event_label string, event_start timestamp_ntz, event_end timestamp_ntz, seq int"


def label(spark, times, events=None, event_id=7, **options):
    events = events if events is not None else [("A", 7, "ANOMALY", START, END, 0)]
    rows = [(i, "A", event_id, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "i int, farm_id string, event_id long, time_stamp timestamp_ntz")
    known = spark.createDataFrame(events, EVENT_SCHEMA)
    return labeling.label_states(df, known, **options).orderBy("i").collect()


def test_boundaries(spark):
    h = lambda n: START - timedelta(hours=n)
    second = timedelta(seconds=1)
    times = [h(72) - second, h(72), h(48) - second, h(48), h(24) - second, h(24), START - second, START, END, END + second]
    assert [r["state_label"] for r in label(spark, times)] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 0]


def test_buffers_only_cover_normal_rows(spark):
    h = lambda n: START - timedelta(hours=n)
    second = timedelta(seconds=1)
    times = [h(78.5) - second, h(78.5), h(72), END, END + second, END + timedelta(hours=2), END + timedelta(hours=2) + second]
    rows = label(spark, times, buffer_before_hours=6.5, buffer_after_hours=2.0)
    assert [r["state_label"] for r in rows] == [0, 5, 1, 4, 5, 5, 0]
    assert [r["target"] for r in rows] == [0.0, None, 1.0, 1.0, None, None, 0.0]
    assert [r["is_excluded_buffer"] for r in rows] == [False, True, False, False, True, True, False]
    assert rows[1]["state_name"] == "excluded_buffer" and rows[2]["state_name"] == "pre_48_72h"


def test_unknown_normal_and_boundless_events_stay_normal(spark):
    assert label(spark, [START], event_id=99)[0].asDict() | {} == {
        "i": 0, "farm_id": "A", "event_id": 99, "time_stamp": START, "event_label": None, "event_start": None,
        "event_end": None, "state_label": 0, "state_name": "normal", "is_excluded_buffer": False, "target": 0.0,
    }
    row = label(spark, [START], [("A", 7, "normal", START, END, 0)])[0]
    assert (row["state_label"], row["event_label"], row["event_start"]) == (0, "normal", START)
    assert label(spark, [START], [("A", 7, "anomaly", None, None, 0)])[0]["state_label"] == 0
    assert label(spark, [START], event_id=None)[0]["target"] == 0.0


def test_first_metadata_row_wins(spark):
    events = [("A", 7, "normal", START, END, 1), ("A", 7, "anomaly", START, END, 0), ("B", 7, "normal", START, END, 2)]
    rows = label(spark, [START], events, order="seq")
    assert len(rows) == 1 and rows[0]["state_label"] == 4


def test_event_id_of_file_names(spark):
    names = ["68.csv", "a1_23.csv", "comparison.csv", "12.34.csv", ".csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(states.event_id_from_stem(states.file_stem(F.col("n")))).collect()]
    assert got == [68, 123, None, 1234, None]


def test_experiment_targets(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (5,), (None,)], "state_label int")
    run = lambda **o: [r["target"] for r in labeling.binary_target(df, **o).collect()]
    assert run(positive_states=["pre_0_24h", 4]) == [0, 0, 0, 1, 1, None, None]
    assert run(positive_states=["excluded_buffer", 1]) == [0, 1, 0, 0, 0, None, None]
    assert run(positive_states=[]) == [0, 0, 0, 0, 0, None, None]
    assert run(positive_states=[4], buffer_state="normal") == [None, 0, 0, 0, 1, 0, None]


def test_target_errors(spark):
    df = spark.createDataFrame([(0,), (6,)], "state_label int")
    with pytest.raises(ValueError, match="6"):
        labeling.binary_target(df, [1])
    for bad in ("pre_0_12h", 9, -1):
        with pytest.raises(ValueError):
            labeling.binary_target(df.limit(1), [bad])
    with pytest.raises(ValueError, match="missing"):
        labeling.binary_target(df.withColumnRenamed("state_label", "s"), [1])


def test_dataset_drops_or_keeps_buffer_rows(spark):
    df = spark.createDataFrame([(c, config.STATE_NAMES[c]) for c in range(6)], "state_label int, state_name string")
    dropped = labeling.experiment_dataset(df, config.experiment("pre_48h")).orderBy("state_label").collect()
    assert [r["target"] for r in dropped] == [0, 0, 1, 1, 1]
    kept = labeling.experiment_dataset(df, config.experiment("pre_48h", buffer_as_negative=True)).orderBy("state_label").collect()
    assert [r["target"] for r in kept] == [0, 0, 1, 1, 1, 0]
    with pytest.raises(KeyError):
        labeling.membership_target(df.drop("state_name"), ["normal"])
    with pytest.raises(ValueError, match="unknown experiment"):
        config.experiment("pre_12h")
