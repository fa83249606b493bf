"""Split sizes, order, isolation and errors."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from windvane.operators import splits

T0 = datetime(2024, 1, 1)


def fleet(spark, histories):
    """histories: (farm, asset, event, rows, start offset in hours)."""
    rows, row_id = [], 0
    for farm, asset, event, n, offset in histories:
        for i in range(n):
            rows.append((farm, asset, event, T0 + timedelta(hours=offset, minutes=10 * i), row_id, float(row_id % 3 == 0)))
            row_id += 1
    return spark.createDataFrame(rows, "farm_id string, asset_id string, event_id long, time_stamp timestamp_ntz, row_id long, target double").repartition(4, "row_id")


MIXED = [("A", "1", 5, 200, 30), ("A", "2", 3, 40, 0), ("B", "1", 9, 1, 12), ("B", "3", 4, 7, 50), ("C", "x", 8, 60, 5)]


def by_part(df):
    parts = {"train": [], "val": [], "test": []}
    for r in df.collect():
        parts[r["split"]].append(r)
    return parts


@pytest.mark.parametrize("rows_per_chunk", [10, 10**6])
def test_global_time(spark, rows_per_chunk):
    df = fleet(spark, MIXED)
    parts = by_part(splits.global_time_split(df, rows_per_chunk=rows_per_chunk))
    n = 308
    assert [len(p) for p in parts.values()] == [int(n * 0.7), int(n * 0.15), n - int(n * 0.7) - int(n * 0.15)]
    key = lambda r: (r["time_stamp"], r["row_id"])
    assert max(map(key, parts["train"])) < min(map(key, parts["val"])) and max(map(key, parts["val"])) < min(map(key, parts["test"]))


@pytest.mark.parametrize("rows_per_chunk", [10, 10**6])
def test_turbine_time(spark, rows_per_chunk):
    df = fleet(spark, MIXED)
    out = splits.turbine_time_split(df, rows_per_chunk=rows_per_chunk).collect()
    assert len(out) == 308
    for farm, asset, _, n, _ in MIXED:
        mine = sorted((r for r in out if (r["farm_id"], r["asset_id"]) == (farm, asset)), key=lambda r: r["row_id"])
        first = int(n * 0.7)
        second = first + int(n * 0.15)
        assert [r["split"] for r in mine] == ["train"] * first + ["val"] * (second - first) + ["test"] * (n - second)


@pytest.mark.parametrize("n,expected", [(1, (0, 0, 1)), (2, (1, 0, 1)), (3, (2, 0, 1)), (20, (14, 3, 3)), (95, (66, 14, 15))])
def test_event_time(spark, n, expected):
    df = fleet(spark, [("ABC"[i % 3], str(i), (i * 37) % 101, 3, (i * 13) % 50) for i in range(n)])
    out = splits.event_time_split(df).collect()
    events = {}
    for r in out:
        events.setdefault((r["farm_id"], r["event_id"]), set()).add(r["split"])
    assert len(out) == 3 * n and all(len(s) == 1 for s in events.values())
    names = [next(iter(s)) for s in events.values()]
    assert tuple(names.count(p) for p in ("train", "val", "test")) == expected


def test_event_time_leaves_out_rows_without_event(spark):
    df = fleet(spark, MIXED).withColumn("event_id", F.when(F.col("row_id") > 5, F.col("event_id")))
    assert splits.event_time_split(df).count() == 302


@pytest.mark.parametrize("n", [10, 100, 333])
def test_random(spark, n):
    df = fleet(spark, [("A", "1", 1, n, 0)])
    a, b = splits.random_split(df).collect(), splits.random_split(df.repartition(7)).collect()
    assert {r["row_id"]: r["split"] for r in a} == {r["row_id"]: r["split"] for r in b}
    held = math.ceil(n * (1.0 - 0.7))
    tested = math.ceil(held * 0.5)
    assert [sum(r["split"] == p for r in a) for p in ("train", "val", "test")] == [n - held, held - tested, tested]
    other = {r["row_id"]: r["split"] for r in splits.random_split(df, seed=1).collect()}
    assert other != {r["row_id"]: r["split"] for r in a}


def test_turbine_holdout(spark):
    histories = [(f, str(i), i, 5, 0) for f, n in (("A", 5), ("B", 9), ("C", 22)) for i in range(n)]
    df = fleet(spark, histories)
    out = splits.turbine_holdout_split(df)
    per = {(r["farm_id"], r["split"]): r["n"] for r in out.groupBy("farm_id", "split").agg(F.countDistinct("asset_id").alias("n")).collect()}
    assert sum(n for (_, s), n in per.items() if s == "test") == math.ceil(0.2 * 36)
    assert per["A", "test"] == 1 and per["B", "test"] == 2 and per["C", "test"] == 5
    assert out.groupBy("farm_id", "asset_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    assert out.count() == len(histories) * 5
    plain = splits.turbine_holdout_split(df, 0.5, stratify_by_farm=False)
    assert plain.filter("split = 'test'").select("farm_id", "asset_id").distinct().count() == 18


def test_turbine_holdout_errors(spark):
    with pytest.raises(ValueError, match="two turbines"):
        splits.turbine_holdout_split(fleet(spark, [("A", "1", 1, 2, 0), ("B", "1", 2, 2, 0), ("B", "2", 3, 2, 0)]))
    with pytest.raises(ValueError, match="room"):
        splits.turbine_holdout_split(fleet(spark, [(f, a, 1, 2, 0) for f in "ABC" for a in "12"]), 0.2)


def test_group_kfold(spark):
    df = fleet(spark, [("A", str(i), i, n, 0) for i, n in enumerate([50, 30, 30, 20, 10, 10, 5])])
    out = splits.group_kfold(df, 3)
    assert out.groupBy("asset_id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    loads = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert loads == {0: 55, 1: 50, 2: 50}
    with pytest.raises(ValueError, match="n_splits"):
        splits.group_kfold(df, 8)
    with pytest.raises(ValueError, match="target"):
        splits.group_kfold(df.drop("target"))


def test_size_checks_and_names(spark):
    df = fleet(spark, MIXED)
    for sizes in [(0.7, 0.15, 0.14), (1.2, -0.1, -0.1)]:
        with pytest.raises(ValueError, match="sizes"):
            splits.split_dataset(df, "global_time", sizes)
    with pytest.raises(ValueError, match="unsupported"):
        splits.split_dataset(df, "by_colour")
    with pytest.raises(ValueError, match="missing"):
        splits.global_time_split(df.drop("time_stamp"))
    for name in splits.METHODS:
        assert splits.split_dataset(df, name).count() == 308
    divided = splits.split_dataset(df, "chronological")
    assert splits.parts(divided, "train", "val").count() + splits.parts(divided, "test").count() == 308


def test_no_empty_test_part_is_invented(spark):
    df = fleet(spark, [("A", "1", 1, 10, 0)])
    parts = by_part(splits.global_time_split(df, 0.5, 0.5, 0.0))
    assert [len(p) for p in parts.values()] == [5, 5, 0]
    parts = by_part(splits.global_time_split(df, 1.0, 0.0, 0.0))
    assert [len(p) for p in parts.values()] == [10, 0, 0]
