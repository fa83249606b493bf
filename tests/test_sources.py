"""Raw files to processed tables, artifacts and guards."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from windvane import config
from windvane.operators import features, harmonize, quality
from windvane.plans.preprocess import preprocess
from windvane.sources import fleet, readers, writers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return path


@pytest.fixture()
def raw_root(tmp_path):
    """Farm A with two header layouts, farm B with one file, farm C without data."""
    root = tmp_path / "raw"
    a = root / "Wind Farm A"
    lines = [f"2024-01-0{1 + i // 144} {i // 6 % 24:02d}:{i % 6}0:00;10;{i};{i % 50};{1000 + i};{i % 9}" for i in range(300)]
    write(a / "datasets" / "68.csv", "time_stamp;asset_id;id;sensor_0_avg;sensor_44;sensor_12_avg\n" + "\n".join(lines) + "\n")
    write(a / "datasets" / "comparison.csv", "asset_id;sensor_12_avg;time_stamp;extra\r\n11;7.5;2024-01-01 00:00:00;zz\r\n11;bad;2024-01-01 00:10:00;zz\r\n")
    write(a / "event_info.csv", "asset;event_id;event_label;event_start;event_start_id;event_end;event_end_id;event_description\r\n"
          "10;68;anomaly;2024-01-02 12:00:00;1;2024-01-02 18:00:00;2;Gearbox failure\r\n10;68;normal;2024-01-02 12:00:00;1;2024-01-02 18:00:00;2;\r\n")
    b = root / "Wind Farm B"
    write(b / "datasets" / "b7.csv", "time_stamp;asset_id;power_62_avg;sensor_32_avg;sensor_33_avg\n2024-02-01 00:00:00;2;5.5;1;2\n2024-02-01 00:10:00;2;;3;\n")
    write(b / "event_info.csv", "asset_id;event_id;event_label;event_start;event_start_id;event_end;event_end_id;event_description\n"
          "2;7;normal;2024-02-01 00:00:00;1;2024-02-01 01:00:00;2;\n")
    write(b / "feature_description.csv", "sensor_name;statistics_type;description;unit;is_angle;is_counter\n"
          "power_62;maximum,minimum,average,std_dev;Power;kW;False;False\nsensor_32;average;Bearing;C;False;True\nsensor_33;average, maximum;Bearing;C;True;False\n")
    return str(root)


def test_headers_bind_by_name(spark, raw_root):
    headers = readers.file_headers(spark, f"{raw_root}/Wind Farm A/datasets").collect()
    assert len({r["header"] for r in headers}) == 2
    rows = readers.read_farms(spark, raw_root).filter("event_id IS NULL").orderBy("time_stamp").collect()
    assert [(r["asset_id"], r["gearbox_oil_temp"], r["amb_temp"]) for r in rows] == [("11", 7.5, None), ("11", None, None)]


def test_only_needed_columns_are_parsed(spark, raw_root):
    raw = readers.read_telemetry(spark, f"{raw_root}/Wind Farm A/datasets", "A")
    assert set(raw.columns) == {"time_stamp", "asset_id", "sensor_0_avg", "sensor_44", "sensor_12_avg", "source_file", "row_id"}
    plan = raw.select("sensor_44")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_c4:string>" in plan  # one scan of both layouts
    plan = readers.read_telemetry(spark, f"{raw_root}/Wind Farm B/datasets", "B").select("sensor_32_avg")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<sensor_32_avg:string>" in plan and "Join" not in plan


def test_event_info_and_catalog(spark, raw_root):
    info = readers.read_event_info(spark, raw_root).orderBy("event_seq").collect()
    assert {(r["farm_id"], r["asset_id"], r["event_id"]) for r in info} == {("A", "10", 68), ("B", "2", 7)}
    assert info[0]["event_start"] == datetime(2024, 1, 2, 12) and any(r["event_description"] == "" for r in info)
    catalog = readers.read_sensor_catalog(spark, raw_root)
    row = catalog.filter("sensor_name = 'sensor_33'").first()
    assert (row["statistics"], row["is_angle"], row["is_counter"]) == (["average", "maximum"], True, False)
    missing = readers.unmapped_channels(harmonize.feature_map_table(spark).filter("farm_id = 'B'"), catalog)
    channels = {r["channel"] for r in missing.collect()}
    assert "sensor_8_avg" in channels and not channels & {"power_62_avg", "sensor_32_avg", "sensor_33_avg"}


def test_preprocess_end_to_end(spark, raw_root, tmp_path):
    out, master = str(tmp_path / "processed"), str(tmp_path / "master")
    preprocess(spark, raw_root, out, master_path=master, buffer_after_hours=1.0)
    table = readers.read_processed(spark, master)
    assert table.schema == readers.processed_schema() and len(table.columns) == 46
    assert table.count() == 304 and readers.read_processed(spark, out).count() == 304
    states = {r["state_name"]: r["count"] for r in table.filter("event_id = 68").groupBy("state_name").count().collect()}
    # 24 h before 12:00 on day two, the event until 18:00 inclusive, one hour of buffer
    assert states == {"pre_0_24h": 144, "pre_24_48h": 72, "event_occurring": 37, "excluded_buffer": 6, "normal": 41}
    row = table.filter("event_id = 68 AND time_stamp = timestamp_ntz'2024-01-01 01:00:00'").first()
    assert row["active_power"] == pytest.approx(1006 * 0.006) and row["event_label"] == "anomaly"
    assert row["gearbox_oil_temp_delta_6"] == 6.0 and row["hydraulic_temp"] == 0.0
    other = table.filter("event_id IS NULL").collect()
    assert len(other) == 2 and all(r["target"] == 0.0 and r["event_label"] is None for r in other)
    farm_b = table.filter("farm_id = 'B'").orderBy("time_stamp").collect()
    assert [r["generator_temp"] for r in farm_b] == [1.5, 3.0] and farm_b[1]["active_power"] == 0.0
    with pytest.raises(FileExistsError):
        preprocess(spark, raw_root, out)
    preprocess(spark, raw_root, out, overwrite=True)


def test_histories_are_files(spark, tmp_path):
    """Files without digits, or with equal digits, stay apart in every window."""
    for names, event in ((("alpha", "beta"), None), (("1_2", "12"), 12)):
        root = tmp_path / names[0]
        for at, name in enumerate(names):
            lines = [f"2024-01-01 {i // 6:02d}:{i % 6}0:00;7;{100 * at + i}" for i in range(30)]
            write(root / "Wind Farm A" / "datasets" / f"{name}.csv", "time_stamp;asset_id;sensor_12_avg\n" + "\n".join(lines) + "\n")
        for limit in (10**6, 10):
            rows = features.derive_features(readers.read_farms(spark, str(root)), rows_per_chunk=limit).collect()
            assert len(rows) == 60 and {r["event_id"] for r in rows} == {event}
            assert {r["gearbox_oil_temp_delta_6"] for r in rows} == {0.0, 6.0}


def test_master_stays_outside(spark, tmp_path):
    for master in (tmp_path / "p", tmp_path / "p" / "master", tmp_path):
        with pytest.raises(ValueError, match="contain"):
            writers.create_master(spark, str(tmp_path / "p"), str(master))


def test_csv_with_other_columns(spark, tmp_path):
    df = spark.createDataFrame([("007", 1.5, "a b", 3), ("8", None, None, None)], "asset_id string, wind_speed double, `free.text` string, other int")
    df.write.option("header", True).csv(str(tmp_path / "x.csv"))
    back = readers.load_dataset(spark, str(tmp_path / "x.csv"))
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_missing_inputs(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    for call in (lambda: readers.read_processed(spark, str(empty)), lambda: readers.read_processed(spark, str(tmp_path / "none")),
                 lambda: readers.read_farms(spark, str(empty)), lambda: readers.read_event_info(spark, str(empty)),
                 lambda: writers.create_master(spark, str(empty), str(tmp_path / "m")),
                 lambda: readers.load_dataset(spark, str(tmp_path / "none.parquet"))):
        with pytest.raises(FileNotFoundError):
            call()
    with pytest.raises(ValueError, match="format"):
        readers.load_dataset(spark, "table.xlsx")


def test_load_dataset_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([("A", datetime(2024, 1, 1), 3, 1.5, "x")], "farm_id string, time_stamp timestamp_ntz, state_label int, wind_speed double, state_name string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    for name in ("t.parquet", "t.csv"):
        assert readers.load_dataset(spark, str(tmp_path / name)).collect() == df.collect()


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.1, datetime(2024, 1, 1, 0, 0, 0, 123456)), (2, None, None, None)], "i long, s string, d double, t timestamp_ntz")
    path = writers.save_table(df, str(tmp_path / "csv"))
    assert writers.load_table(spark, path, df.schema).orderBy("i").collect() == df.collect()
    path = writers.save_json(df, str(tmp_path / "json"))
    assert writers.load_json(spark, path, df.schema).orderBy("i").collect() == df.collect()
    assert writers.as_json(df.select("i", "s").filter("i = 2")).first()[0] == '{"i":2,"s":null}'
    with pytest.raises(FileExistsError):
        writers.save_json(df, str(tmp_path / "json"), overwrite=False)
    with pytest.raises(TypeError):
        writers.save_table([1], str(tmp_path / "x"))


def test_inspection(spark, tmp_path):
    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    assert readers.row_count(df).first()[0] == 1000
    assert readers.file_inventory(df).count() == 2
    assert readers.schema_table(df).first().asDict() == {"position": 0, "column": "id", "type": "bigint", "nullable": True}
    assert [r["id"] for r in readers.sample_rows(df, 3, ("id",)).collect()] == [0, 1, 2]
    assert readers.sample_rows(df, 7).count() == 7


def test_fixed_schema_matches_groups():
    names = readers.processed_schema().fieldNames()
    assert names[:3] == list(config.IDENTITY_COLUMNS) and names[-8:] == list(config.LABEL_COLUMNS)


def test_saving_a_run_again_replaces_it(spark, tmp_path):
    first = spark.createDataFrame([(1, 0.5), (2, 0.25)], "n int, f1 double")
    listed = spark.createDataFrame([("m", ["a", "b"])], "name string, features array<string>")
    for table in (first, first.limit(1), first):
        saved = writers.save_run({"board": table, "meta": listed}, str(tmp_path), "pre_24h", "r1")
    writers.save_run({"board": first, "meta": listed}, str(tmp_path), "pre_24h", "r2")
    board = writers.load_table(spark, saved["board"], "n int, f1 double, experiment string, run_id string")
    assert sorted((r["run_id"], r["n"]) for r in board.collect()) == [("r1", 1), ("r1", 2), ("r2", 1), ("r2", 2)]
    assert writers.load_json(spark, saved["meta"]).count() == 2


def _scanned(df):
    """Rows that the file scan of a plan gave on."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_master_is_clustered_by_turbine_and_time(spark, tmp_path):
    """The window of one event reads less than a quarter of the rows; the whole table is unchanged."""
    table = fleet.processed(spark, "/root/testdata/sf0.1", 6.0)
    checks = writers.write_checked(table, str(tmp_path / "processed"))
    writers.create_master(spark, str(tmp_path / "processed"), str(tmp_path / "master"))
    master = readers.read_processed(spark, str(tmp_path / "master"))
    assert master.count() == checks["n_rows"] == 100_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        window = master.filter("farm_id = 'A' AND asset_id = '3' AND time_stamp BETWEEN timestamp_ntz'2024-01-10' AND timestamp_ntz'2024-01-14'")
        kept = window.count()
        assert 0 < kept <= _scanned(window.select("time_stamp", "active_power")) < 25_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_write_checks_equal_the_reports(spark, tmp_path):
    table = fleet.processed(spark, "/root/testdata/sf0.001", 6.0)
    odd = table.withColumns({
        "state_label": F.when(F.col("wind_speed") > 20, 9).otherwise(F.col("state_label")),
        "target": F.when(F.col("wind_speed") < 3, 0.5).otherwise(F.col("target")),
        "yaw_error": F.when(F.col("wind_speed") > 10, float("nan")).otherwise(F.col("yaw_error")),
    })
    checks = writers.write_checked(odd, str(tmp_path / "processed"))
    report = {r["rule"]: r["violations"] for r in quality.label_validation(odd).collect()}
    assert {k: checks[k] for k in report} == report and report["unknown_state"] > 0 and report["non_binary_target"] > 0
    coverage = {r["column"]: r["non_null"] for r in quality.feature_coverage(odd).collect()}
    assert {k: checks[f"with_values.{k}"] for k in ("yaw_error", "target", "wind_speed")} == {k: coverage[k] for k in ("yaw_error", "target", "wind_speed")}
