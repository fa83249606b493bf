"""The chunked ranks, prefix sums and halos against plain pandas, on lopsided data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from windvane.operators import features, ordered_chunks
from windvane.operators.ordered_chunks import FANOUT, OrderedChunks, rows_at, with_halo, with_rank


def lopsided(seed=0, n=3000):
    """One history has most rows; a third of those share one instant; times cluster."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    offset = np.where(rng.random(n) < 0.5, rng.integers(0, 3600, n), rng.integers(0, 90 * 86400, n))
    offset = np.where((key == "hot") & (rng.random(n) < 0.33), 777, offset)
    time = pd.Timestamp("2024-01-01") + pd.to_timedelta(offset, unit="s")
    return pd.DataFrame({"key": key, "time_stamp": time, "row_id": rng.permutation(n), "x": rng.normal(size=n).round(6)})


def to_spark(spark, pdf):
    rows = [(r.key, r.time_stamp.to_pydatetime(), int(r.row_id), float(r.x)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "key string, time_stamp timestamp_ntz, row_id long, x double").repartition(5, "row_id")


@pytest.mark.parametrize("rows_per_chunk", [50, 400, 10**6])
def test_rank_equals_global_sort(spark, rows_per_chunk):
    pdf = lopsided()
    expected = pdf.sort_values(["key", "time_stamp", "row_id"]).assign(rank=lambda d: d.groupby("key").cumcount() + 1)
    ranked = with_rank(to_spark(spark, pdf), ["key"], ["time_stamp", "row_id"], rows_per_chunk=rows_per_chunk)
    got = {r["row_id"]: r["rank"] for r in ranked.collect()}
    assert got == dict(zip(expected["row_id"], expected["rank"]))


def test_no_chunk_outgrows_its_bound(spark):
    df = to_spark(spark, lopsided())
    layout = OrderedChunks.plan(df, ["key"], ["time_stamp", "row_id"], rows_per_chunk=100)
    sizes = layout.assign(df).groupBy("key", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 100
    assert sum(r["count"] for r in sizes) == 3000


def test_rank_of_one_instant_falls_through_to_the_tiebreak(spark):
    df = spark.range(5000).select(
        F.lit("k").alias("key"), F.lit("2024-05-05").cast("timestamp_ntz").alias("time_stamp"), (F.col("id") * 7 % 5000).alias("row_id")
    )
    layout = OrderedChunks.plan(df, ["key"], ["time_stamp", "row_id"], rows_per_chunk=500)
    assert not layout.trivial
    ranked = with_rank(df, ["key"], ["time_stamp", "row_id"], rows_per_chunk=500)
    assert ranked.filter(F.col("rank") != F.col("row_id") + 1).count() == 0


def test_identical_rows_stay_together_and_whole(spark):
    df = spark.range(300).select(F.lit(1).alias("key"), F.lit(2.5).alias("v"))
    ranked = with_rank(df, ["key"], ["v"], rows_per_chunk=50)
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 301))


def test_missing_key_and_missing_time_sort_last(spark):
    rows = [(None, None, i) if i % 3 == 0 else (None, f"2024-01-01 00:00:{i % 60:02d}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, t string, row_id long").withColumn("time_stamp", F.col("t").cast("timestamp_ntz"))
    ranked = with_rank(df, ["key"], ["time_stamp", "row_id"], rows_per_chunk=20).collect()
    by_rank = [r["row_id"] for r in sorted(ranked, key=lambda r: r["rank"])]
    known = sorted((i for i in range(200) if i % 3), key=lambda i: (i % 60, i))
    assert by_rank == known + [i for i in range(200) if i % 3 == 0]


@pytest.mark.parametrize("gathered", [1 << 16, 500, 0])
@pytest.mark.parametrize("positions", [[0, 1500, 2999], [5, 6], [3000], []])
def test_rows_at_match_the_sorted_table(spark, monkeypatch, positions, gathered):
    monkeypatch.setattr(ordered_chunks, "GATHER_ROWS", gathered)
    pdf = lopsided(3).sort_values(["time_stamp", "row_id"]).reset_index(drop=True)
    df = to_spark(spark, pdf)
    asked = spark.createDataFrame([(p,) for p in positions], "_position long")
    found = rows_at(df, [], ["time_stamp", "row_id"], df.agg(F.count("*").alias("_rows")), asked).collect()
    assert {r["_position"]: r["row_id"] for r in found} == {p: pdf["row_id"][p] for p in positions if p < 3000}


@pytest.mark.parametrize("gathered", [1 << 16, 500, 0])
def test_rows_at_in_many_histories_at_once(spark, monkeypatch, gathered):
    """Every history has its own positions; one holds most rows, some hold one row, one has a NULL key."""
    monkeypatch.setattr(ordered_chunks, "GATHER_ROWS", gathered)
    pdf = lopsided(9)
    rows = [(None if k == "a" else k, t.to_pydatetime(), int(i)) for k, t, i in zip(pdf["key"], pdf["time_stamp"], pdf["row_id"])]
    rows += [(f"small {i}", None if i % 2 else rows[i][1], 10_000 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, time_stamp timestamp_ntz, row_id long").repartition(6, "row_id")
    sizes = df.groupBy("key").agg(F.count("*").alias("_rows"))
    asked = sizes.selectExpr("key", "explode(array(0L, _rows div 3, _rows - 1)) AS _position").distinct()
    got = {(r["key"], r["_position"]): r["row_id"] for r in rows_at(df, ["key"], ["time_stamp", "row_id"], sizes, asked).collect()}
    whole = df.selectExpr("key", "row_id", "row_number() OVER (PARTITION BY key ORDER BY time_stamp ASC NULLS LAST, row_id) - 1 AS nth").collect()
    nth = {(r["key"], r["nth"]): r["row_id"] for r in whole}
    assert got == {(r["key"], r["_position"]): nth[r["key"], r["_position"]] for r in asked.collect()}


def test_halo_reaches_back_far_enough(spark):
    pdf = lopsided(5)
    df = to_spark(spark, pdf)
    layout = OrderedChunks.plan(df, ["key"], ["time_stamp", "row_id"], halo=40, rows_per_chunk=150)
    out = with_halo(layout, df).toPandas().sort_values(["key", "_chunk", "time_stamp", "row_id"])
    own = out[~out["_is_halo"]]
    assert sorted(own["row_id"]) == list(range(3000))
    for (key, chunk), part in out.groupby(["key", "_chunk"]):
        flags = part["_is_halo"].tolist()
        assert flags == sorted(flags, reverse=True), "halo rows come first"
        before = own[(own["key"] == key) & (own["_chunk"] < chunk)]
        assert sum(flags) >= min(40, len(before))
        expected = before.sort_values(["time_stamp", "row_id"])["row_id"].tolist()
        assert part["row_id"].tolist()[: sum(flags)] == expected[len(expected) - sum(flags):]


@pytest.mark.parametrize("seed", [1, 2])
def test_temporal_features_do_not_depend_on_chunking(spark, seed):
    pdf = lopsided(seed)
    df = to_spark(spark, pdf).select(
        F.lit("A").alias("farm_id"), F.col("key").alias("event_id"), "time_stamp", "row_id",
        F.when(F.col("row_id") % 13 != 0, F.col("x")).alias("gen_speed"), F.col("x").alias("gearbox_oil_temp"),
        (F.col("x") * 3).alias("active_power"),
    )
    whole = features.temporal_features(df)
    cut = features.temporal_features(df, rows_per_chunk=160)
    columns = sorted(whole.columns)
    a = whole.select(columns).toPandas().sort_values("row_id").reset_index(drop=True)
    b = cut.select(columns).toPandas().sort_values("row_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("values, dtype", [
    ([2**60 + i for i in range(900)] + [-(2**60) - i for i in range(90)] + [None] * 9, "long"),
    ([None if i % 5 == 0 else i % 70 for i in range(900)], "int"),
    ([f"name-{i % 7}-{i}" for i in range(900)] + ["", None, "é", "a", "a" * 40 + "b", "a" * 40 + "a"], "string"),
    ([1e308 + i * 1e304 for i in range(300)] + [float("inf"), float("-inf"), float("nan"), None, 0.0, -1e308] * 40, "double"),
])
def test_order_columns_of_any_type(spark, values, dtype):
    rows = [("k", v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"key string, v {dtype}, row_id long").repartition(4, "row_id")
    ranked = with_rank(df, ["key"], ["v", "row_id"], rows_per_chunk=50).collect()
    whole = df.withColumn("rank", F.expr("row_number() OVER (ORDER BY v ASC NULLS LAST, row_id)")).collect()
    assert {r["row_id"]: r["rank"] for r in ranked} == {r["row_id"]: r["rank"] for r in whole}


def test_ties_of_an_instant_are_cut_by_a_text(spark):
    df = spark.range(3000).selectExpr("'k' AS key", "timestamp_ntz'2024-05-05' AS time_stamp", "concat('row ', lpad(id, 6, '0')) AS name")
    layout = OrderedChunks.plan(df, ["key"], ["time_stamp", "name"], rows_per_chunk=100)
    assert layout.assign(df).groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 100


def test_long_names_with_one_prefix_are_cut(spark):
    """4,000 texts that differ only behind their first 36 bytes."""
    df = spark.range(4000).selectExpr("'k' AS key", "concat('s3://fleet/raw/2024/Wind Farm A/data', lpad(id * 7 % 4000, 5, '0'), '.csv') AS name")
    layout = OrderedChunks.plan(df, ["key"], ["name"], rows_per_chunk=100)
    assert layout.located(df).groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 100
    ranked = with_rank(df, ["key"], ["name"], rows_per_chunk=100)
    assert ranked.filter(F.expr("rank - 1 <> int(substring(name, 37, 5))")).count() == 0


def test_a_hundred_thousand_chunks(spark):
    """The splitter tree is three levels deep; no chunk outgrows its bound, and lags equal those of the uncut window."""
    df = spark.range(0, 300_000, 1, 8).selectExpr(
        "'k' AS key", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id div 5) AS time_stamp", "(id * 7919) % 300000 AS row_id", "double(id % 91) AS x"
    )
    layout = OrderedChunks.plan(df, ["key"], ["time_stamp", "row_id"], halo=4, rows_per_chunk=4)
    chunks, largest = layout.located(df).groupBy("_chunk").count().agg(F.count("*"), F.max("count")).first()
    assert chunks >= 100_000 and largest <= 4
    assert len(layout._tree("_low").levels) == 3 and FANOUT == 64
    lag = "x - lag(x, 4) OVER (PARTITION BY key{} ORDER BY time_stamp, row_id)"
    cut = with_halo(layout, df).selectExpr("row_id", "_is_halo", lag.format(", _chunk") + " AS d").filter("NOT _is_halo").drop("_is_halo")
    whole = df.selectExpr("row_id", lag.format("") + " AS d")
    assert cut.count() == 300_000
    assert cut.exceptAll(whole).count() == 0
