"""

Every query runs over the whole ``events`` table, seen as a turbine fleet
(``windvane.sources.fleet``); the SQL below states the same view and each operator's
result independently, for a second engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane import config
from windvane.functions import sensors, states
from windvane.operators import features, harmonize, labeling, metrics, quality, selection, splits, timeline
from windvane.operators.ordered_chunks import with_rank
from windvane.plans import experiments, training
from windvane.session import scratch_folder
from windvane.sources import fleet, readers, writers

SMOKE_DIR = "/root/testdata/sf0.001"
TEMPORAL = list(config.TEMPORAL_FEATURES)
VOLATILITY = [c for c in TEMPORAL if "_volatility_" in c]
DELTA = [c for c in TEMPORAL if "_delta_" in c]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLE[name] = sql
        return function

    return register


def _rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Order-dependent floating sums agree to rounding between engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------------------

SCADA = """
base AS (
  SELECT event_id AS row_id, ts AS time_stamp, user_id % 15 AS t, value, event_type,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events),
scada AS (
  SELECT time_stamp, CASE t % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS farm_id,
         CAST(t AS VARCHAR) AS asset_id, t AS event_id, row_id,
         CAST(row_id % 40 - 5 AS DOUBLE) AS amb_temp,
         CASE WHEN row_id % 97 <> 0 THEN k / 4 END AS wind_speed,
         CAST(CAST(k AS BIGINT) % 30 AS DOUBLE) AS pitch_angle,
         value AS active_power,
         CASE WHEN row_id % 97 <> 0 THEN k END AS gen_speed,
         CASE WHEN row_id % 97 <> 0 THEN 40 + value / 10 END AS gearbox_oil_temp,
         35 + k / 3 AS transformer_temp,
         20 + k / 5 AS nacelle_temp,
         CAST(row_id % 17 + 15 AS DOUBLE) AS hub_temp,
         CASE WHEN t <> 3 THEN CAST((row_id * 29) % 90 AS DOUBLE) END AS yaw_error,
         value - 20 AS vibration_raw,
         CASE WHEN t % 3 <> 1 THEN 30 + value / 25 END AS hydraulic_temp,
         CASE WHEN row_id % 7 <> 0 THEN ((50 + value / 8) + (48 + k / 6)) / 2 ELSE 48 + k / 6 END AS generator_temp,
         (row_id * 37) % 360 AS wind_direction,
         (row_id * 53) % 360 AS nacelle_direction
  FROM base)"""
HARM = SCADA + """,
harm AS (
  SELECT * REPLACE (
    CASE WHEN farm_id = 'A' THEN active_power * CAST(0.006 AS DOUBLE) ELSE active_power END AS active_power,
    CASE WHEN farm_id = 'C' THEN gen_speed * (CAST(60 AS DOUBLE) / (CAST(2 AS DOUBLE) * pi())) ELSE gen_speed END AS gen_speed)
  FROM scada)"""


def _sql_std(column: str, rows: int) -> str:
    frame = f"(PARTITION BY farm_id, event_id ORDER BY time_stamp, row_id ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {frame} = {rows} THEN stddev_samp({column}) OVER {frame} END"


def _sql_delta(column: str, rows: int) -> str:
    return f"{column} - lag({column}, {rows}) OVER (PARTITION BY farm_id, event_id ORDER BY time_stamp, row_id)"


SQL_TEMPORAL = {
    f"{c}_{kind}_{w}": (_sql_delta(c, w) if kind == "delta" else _sql_std(c, w))
    for c in ("gearbox_oil_temp", "generator_temp", "active_power", "yaw_error")
    for w in (6, 24)
    for kind in ("delta", "volatility")
}
SQL_WINDOW = {
    "temp_trend_24h": _sql_delta("gearbox_oil_temp", 144),
    "rpm_volatility": _sql_std("gen_speed", 36),
    **SQL_TEMPORAL,
}
SQL_PHYSICS = {
    "temp_delta_gearbox": "coalesce(gearbox_oil_temp - amb_temp, 0)",
    "temp_divergence": "nacelle_temp - hub_temp",
    "power_efficiency": "CASE WHEN wind_speed * wind_speed * wind_speed > CAST(0.1 AS DOUBLE)"
    " THEN coalesce(active_power / (wind_speed * wind_speed * wind_speed), 0) ELSE 0 END",
    "vibration_magnitude": "abs(vibration_raw)",
}
_STANDARD = list(config.STANDARD_FEATURES)
_COMPUTED = {**SQL_PHYSICS, **SQL_WINDOW}


def _feature_output(column: str) -> str:
    inner = f"round({column}, 6)" if "volatility" in column else column
    return f"coalesce({inner}, 0) AS {column}"


FEAT = HARM + ",\nderived AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _COMPUTED.items()) + " FROM harm)" + (
    ",\nfeat AS (SELECT time_stamp, farm_id, asset_id, event_id, row_id, "
    + ", ".join(_feature_output(c) for c in [*_STANDARD, *_COMPUTED])
    + " FROM derived)"
)
FAULTS = """,
faults AS (
  SELECT CASE t % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS farm_id, CAST(t AS VARCHAR) AS asset_id, t AS event_id,
         CASE WHEN t % 3 <> 0 THEN 'anomaly' ELSE 'normal' END AS event_label,
         min(time_stamp) AS event_start, min(time_stamp) + INTERVAL 36 HOUR AS event_end
  FROM base WHERE event_type = 'error' AND time_stamp >= TIMESTAMP '2024-01-12' GROUP BY t)"""


def _labels(source: str, hours: int) -> str:
    before = f"WHEN time_stamp >= event_start - INTERVAL {72 + hours} HOUR AND time_stamp < event_start - INTERVAL 72 HOUR THEN 5" if hours else ""
    after = f"WHEN time_stamp > event_end AND time_stamp <= event_end + INTERVAL {hours} HOUR THEN 5" if hours else ""
    return FAULTS + f""",
coded AS (
  SELECT s.*, f.event_label, f.event_start, f.event_end, CAST(CASE
    WHEN f.event_label IS NULL OR f.event_label <> 'anomaly' THEN 0
    WHEN time_stamp >= event_start AND time_stamp <= event_end THEN 4
    WHEN time_stamp >= event_start - INTERVAL 24 HOUR AND time_stamp < event_start THEN 3
    WHEN time_stamp >= event_start - INTERVAL 48 HOUR AND time_stamp < event_start - INTERVAL 24 HOUR THEN 2
    WHEN time_stamp >= event_start - INTERVAL 72 HOUR AND time_stamp < event_start - INTERVAL 48 HOUR THEN 1
    {before} {after} ELSE 0 END AS INTEGER) AS state_label
  FROM {source} s LEFT JOIN faults f ON s.farm_id = f.farm_id AND s.event_id = f.event_id),
lab AS (
  SELECT *, CASE state_label WHEN 0 THEN 'normal' WHEN 1 THEN 'pre_48_72h' WHEN 2 THEN 'pre_24_48h'
              WHEN 3 THEN 'pre_0_24h' WHEN 4 THEN 'event_occurring' ELSE 'excluded_buffer' END AS state_name,
         state_label = 5 AS is_excluded_buffer,
         CAST(CASE WHEN state_label BETWEEN 1 AND 4 THEN 1 WHEN state_label = 0 THEN 0 END AS DOUBLE) AS target
  FROM coded)"""


LAB = HARM + _labels("harm", 6)
PROC = FEAT + _labels("feat", 6)
SCORED = """
sc AS (
  SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true,
         CAST(0.7 AS DOUBLE) * (CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000)
         + CAST(0.3 AS DOUBLE) * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_prob
  FROM events)"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


LABEL_OUT = "row_id, event_label, event_start, event_end, state_label, state_name, is_excluded_buffer, target"

# ---------------------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------------------


def _export_raw(spark: SparkSession, sf_dir: str) -> str:
    """Write the fleet as per-farm ';' CSV folders with farm-specific channel names."""
    root = scratch_folder(spark, "raw-fleet")
    for farm in config.FARM_CHANNELS:
        raw = fleet.raw_channels(spark, sf_dir, farm).drop("row_id")
        raw.write.option("sep", ";").option("header", True).csv(f"{root}/Wind Farm {farm}/datasets")
    return root


def _channel_sql(farm: str, parity: int, keep: str) -> str:
    """Mapped features of one farm straight from the events table."""
    columns = []
    for place, feature in enumerate(config.STANDARD_FEATURES):
        n = len(config.FARM_CHANNELS[farm][feature])
        parts = [f"(value + k * {place} + {i})" for i in range(n)]
        if n == 0:
            expr = "CAST(NULL AS DOUBLE)"
        elif n == 1:
            expr = f"CASE WHEN row_id % 11 <> 0 THEN {parts[0]} END"
        else:
            total, count = "CAST(0 AS DOUBLE)", "0"
            for i, part in enumerate(parts):
                total += f" + CASE WHEN (row_id + {i}) % 7 <> 0 THEN {part} ELSE 0 END"
                count += f" + CASE WHEN (row_id + {i}) % 7 <> 0 THEN 1 ELSE 0 END"
            expr = f"CASE WHEN {count} > 0 THEN ({total}) / ({count}) END"
        columns.append(f"{expr} AS {feature}")
    return f"SELECT {keep}, {', '.join(columns)} FROM base WHERE t % 3 = {parity}"


def _mapped_sql(keep: str) -> str:
    keeps = [keep.replace("$farm", farm) for farm in "ABC"]
    return " UNION ALL ".join(_channel_sql(f, i, keeps[i]) for i, f in enumerate("ABC"))


_BASE_ONLY = SCADA[: SCADA.index(",\nscada AS")]


@query("scada_scan", sql(_BASE_ONLY, _mapped_sql("time_stamp, '$farm' AS farm_id, CAST(t AS VARCHAR) AS asset_id")))
def scada_scan(spark, sf_dir):
    root = _export_raw(spark, sf_dir)
    return readers.read_farms(spark, root).select(*config.IDENTITY_COLUMNS, *config.STANDARD_FEATURES)


_IDENTITY_SQL = "time_stamp, '$farm' AS farm_id, CAST(t AS VARCHAR) AS asset_id"
_SINGLES = ["wind_speed", "pitch_angle", "gen_speed", "hub_temp", "nacelle_temp", "amb_temp"]
_AVERAGED = ["active_power", "gearbox_oil_temp", "transformer_temp", "yaw_error", "vibration_raw", "hydraulic_temp", "generator_temp"]


@query("map_sensors", sql(_BASE_ONLY, f"""
SELECT row_id, time_stamp, farm_id, asset_id, {', '.join(_SINGLES)} FROM ({_mapped_sql('row_id, ' + _IDENTITY_SQL)})"""))
def map_sensors(spark, sf_dir):
    return _map_fleet(spark, sf_dir).select("row_id", *config.IDENTITY_COLUMNS, *_SINGLES)


def _map_fleet(spark, sf_dir):
    parts = [
        harmonize.map_sensors(fleet.raw_channels(spark, sf_dir, farm), farm, keep=("row_id",)) for farm in config.FARM_CHANNELS
    ]
    return harmonize.union_farms(parts)


@query("map_sensors_multi", sql(_BASE_ONLY, f"SELECT row_id, {', '.join(_AVERAGED)} FROM ({_mapped_sql('row_id')})"))
def map_sensors_multi(spark, sf_dir):
    return _map_fleet(spark, sf_dir).select("row_id", *_AVERAGED)


_MAP_ROWS = ", ".join(
    f"('{farm}', '{feature}', '{channel}', {pos})"
    for farm, mapping in config.FARM_CHANNELS.items()
    for feature, refs in mapping.items()
    for pos, channel in enumerate(refs, 1)
)


@query("feature_map_table", sql(SCADA, f"""
SELECT m.farm_id, m.feature, m.channel, m.pos, s.n_rows
FROM (VALUES {_MAP_ROWS}) AS m(farm_id, feature, channel, pos)
JOIN (SELECT farm_id, count(*) AS n_rows FROM scada GROUP BY farm_id) s ON m.farm_id = s.farm_id"""))
def feature_map_table(spark, sf_dir):
    rows = fleet.telemetry(spark, sf_dir).groupBy("farm_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(F.broadcast(harmonize.feature_map_table(spark)), "farm_id")


@query("event_info_scan", sql(SCADA + FAULTS, """
SELECT farm_id, asset_id, event_id, event_label, event_start, event_end,
       CASE WHEN event_label = 'anomaly' THEN 'fault of ' || asset_id ELSE '' END AS event_description FROM faults"""))
def event_info_scan(spark, sf_dir):
    root = scratch_folder(spark, "event-info")
    known = fleet.faults(spark, sf_dir)
    for farm in config.FARM_CHANNELS:
        asset = "asset" if farm == "A" else "asset_id"
        known.filter(F.col("farm_id") == farm).select(
            F.col("asset_id").alias(asset), "event_id", "event_label",
            F.col("event_start").cast("string"), F.lit(0).alias("event_start_id"),
            F.col("event_end").cast("string"), F.lit(0).alias("event_end_id"),
            F.when(F.col("event_label") == "anomaly", F.concat(F.lit("fault of "), "asset_id")).alias("event_description"),
        ).write.option("sep", ";").option("header", True).csv(f"{root}/Wind Farm {farm}/event_info.csv")
    info = readers.read_event_info(spark, root)
    return info.drop("event_start_id", "event_end_id", "event_seq")


_MASTER_OUT = ["time_stamp", "farm_id", "asset_id", "event_id", "amb_temp", "power_efficiency", "rpm_volatility", "yaw_error_delta_6",
               "event_start", "state_label", "is_excluded_buffer", "target"]


@query("master_dataset", sql(PROC, f"SELECT {', '.join(_MASTER_OUT)} FROM lab"))
def master_dataset(spark, sf_dir):
    root = scratch_folder(spark, "master")
    writers.write_processed(fleet.processed(spark, sf_dir, 6.0), f"{root}/processed")
    writers.create_master(spark, f"{root}/processed", f"{root}/master")
    return _rounded(readers.read_processed(spark, f"{root}/master").select(*_MASTER_OUT), ["rpm_volatility"])


@query("row_count", "SELECT count(*) AS n_rows FROM events")
def row_count(spark, sf_dir):
    return readers.row_count(fleet.telemetry(spark, sf_dir))


_CATALOG = {"time_stamp": "timestamp_ntz", "farm_id": "string", "asset_id": "string", "event_id": "bigint", "row_id": "bigint",
            **{c: "double" for c in _STANDARD}, "wind_direction": "bigint", "nacelle_direction": "bigint"}


@query("schema_catalog", sql(SCADA, " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null FROM scada" for i, (c, t) in enumerate(_CATALOG.items()))))
def schema_catalog(spark, sf_dir):
    table = fleet.telemetry(spark, sf_dir)
    filled = quality.feature_coverage(table, {"all": table.columns}).select("column", "non_null")
    return readers.schema_table(table).drop("nullable").join(filled, "column").select("position", "column", "type", "non_null")


@query("file_inventory")
def file_inventory(spark, sf_dir):
    return readers.file_inventory(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("file_rows", "SELECT 'events.parquet' AS file_name, count(*) AS n_rows FROM events")
def file_rows(spark, sf_dir):
    return readers.rows_per_file(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("dataset_csv", sql(SCADA, "SELECT time_stamp, farm_id, asset_id, wind_speed, row_id, 'row ' || CAST(row_id % 7 AS VARCHAR) AS note FROM scada"))
def dataset_csv(spark, sf_dir):
    """A CSV table with columns outside the processed schema, written and loaded by suffix."""
    path = f"{scratch_folder(spark, 'dataset')}/table.csv"
    table = fleet.telemetry(spark, sf_dir).selectExpr("time_stamp", "farm_id", "asset_id", "wind_speed", "row_id", "concat('row ', row_id % 7) AS note")
    writers.save_table(table, path)
    return readers.load_dataset(spark, path)


@query("run_sink", sql(LAB, "SELECT 'pre_24h' AS experiment, 'r1' AS run_id, state_name, count(*) AS n_rows FROM lab GROUP BY state_name"))
def run_sink(spark, sf_dir):
    """A result table of a run, saved with its experiment and run and read back."""
    counts = fleet.labelled(spark, sf_dir).groupBy("state_name").agg(F.count(F.lit(1)).alias("n_rows"))
    saved = writers.save_run({"states": counts}, scratch_folder(spark, "runs"), "pre_24h", "r1")
    return writers.load_table(spark, saved["states"], "state_name string, n_rows bigint, experiment string, run_id string")


@query("run_sink_again", sql(LAB, """
SELECT 'pre_24h' AS experiment, 'r1' AS run_id, state_name, count(*) AS n_rows FROM lab GROUP BY state_name
UNION ALL SELECT 'pre_24h', 'r2', state_name, count(*) FROM lab WHERE target = 1 GROUP BY state_name"""))
def run_sink_again(spark, sf_dir):
    """A run saved twice, the first time with other rows, beside another run: the second save replaces the first."""
    lab, root = fleet.labelled(spark, sf_dir), scratch_folder(spark, "runs")
    counts = lambda rows: {"states": rows.groupBy("state_name").agg(F.count(F.lit(1)).alias("n_rows"))}
    for run_id, rows in (("r1", lab.filter("target IS NULL")), ("r2", lab.filter("target = 1")), ("r1", lab)):
        saved = writers.save_run(counts(rows), root, "pre_24h", run_id)
    return writers.load_table(spark, saved["states"], "state_name string, n_rows bigint, experiment string, run_id string")


@query("checked_write", sql(PROC, """
SELECT 'n_rows' AS check_name, count(*) AS n FROM lab
UNION ALL SELECT 'unknown_state', count(*) FILTER (WHERE state_label NOT IN (0, 1, 2, 3, 4, 5)) FROM lab
UNION ALL SELECT 'non_binary_target', count(*) FILTER (WHERE NOT is_excluded_buffer AND target NOT IN (0, 1)) FROM lab
UNION ALL SELECT 'with_values.target', count(target) FROM lab UNION ALL SELECT 'with_values.event_start', count(event_start) FROM lab
UNION ALL SELECT 'with_values.yaw_error', count(yaw_error) FROM lab"""))
def checked_write(spark, sf_dir):
    """Validation counts that the write of the processed table takes along."""
    counts = writers.write_checked(fleet.processed(spark, sf_dir, 6.0), f"{scratch_folder(spark, 'checked')}/processed")
    names = ("n_rows", "unknown_state", "non_binary_target", "with_values.target", "with_values.event_start", "with_values.yaw_error")
    return spark.createDataFrame([(name, counts[name]) for name in names], "check_name string, n bigint")


@query("sample_rows", sql(SCADA, "SELECT row_id, time_stamp, farm_id, asset_id, active_power, gen_speed FROM scada ORDER BY time_stamp, row_id LIMIT 5000"))
def sample_rows(spark, sf_dir):
    table = fleet.telemetry(spark, sf_dir).select("row_id", "time_stamp", "farm_id", "asset_id", "active_power", "gen_speed")
    return readers.sample_rows(table, 5000, ("time_stamp", "row_id"))


@query("artifact_roundtrip", sql(SCADA, """
SELECT farm_id, asset_id, count(*) AS n_rows, min(time_stamp) AS first_time, max(active_power) AS top_power FROM scada GROUP BY farm_id, asset_id"""))
def artifact_roundtrip(spark, sf_dir):
    table = fleet.telemetry(spark, sf_dir).groupBy("farm_id", "asset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("time_stamp").alias("first_time"), F.max("active_power").alias("top_power")
    )
    path = writers.save_table(table, scratch_folder(spark, "artifact"))
    return writers.load_table(spark, path, table.schema)


@query("metrics_json", sql(SCORED, """
SELECT '{"tn":' || count(*) FILTER (WHERE y_true = 0 AND y_prob < 0.5) || ',"fp":' || count(*) FILTER (WHERE y_true = 0 AND y_prob >= 0.5)
    || ',"fn":' || count(*) FILTER (WHERE y_true = 1 AND y_prob < 0.5) || ',"tp":' || count(*) FILTER (WHERE y_true = 1 AND y_prob >= 0.5)
    || ',"note":null}' AS json FROM sc"""))
def metrics_json(spark, sf_dir):
    counts = metrics.confusion_counts(metrics.at_threshold(fleet.scores(spark, sf_dir), 0.5))
    table = counts.withColumn("note", F.lit(None).cast("string"))
    path = writers.save_json(table, scratch_folder(spark, "metrics"))
    return writers.as_json(writers.load_json(spark, path, table.schema))


# ---------------------------------------------------------------------------------------
# Harmonization and features
# ---------------------------------------------------------------------------------------

@query("coerce_numeric", sql(SCADA, """
SELECT row_id, CASE row_id % 8 WHEN 0 THEN NULL WHEN 1 THEN value WHEN 2 THEN NULL WHEN 3 THEN value WHEN 4 THEN CAST(row_id AS DOUBLE) * 1000
  WHEN 5 THEN NULL WHEN 6 THEN CAST('inf' AS DOUBLE) ELSE NULL END AS number FROM base"""))
def coerce_numeric(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    value, row = F.col("value").cast("string"), F.col("event_id").cast("string")
    text = F.lit(None).cast("string")
    forms = [F.lit("n/a"), value, F.concat(value, F.lit("d")), F.concat(F.lit(" "), value, F.lit(" ")),
             F.concat(row, F.lit("e3")), F.lit("nan"), F.lit("inf"), F.lit("")]
    for i, form in enumerate(forms):
        text = F.when(F.col("event_id") % 8 == i, form).otherwise(text)
    return events.select(F.col("event_id").alias("row_id"), text.alias("text")).select("row_id", sensors.to_number("text").alias("number"))


@query("unit_normalize", sql(HARM, "SELECT row_id, farm_id, active_power, gen_speed FROM harm"))
def unit_normalize(spark, sf_dir):
    return fleet.harmonized(spark, sf_dir).select("row_id", "farm_id", "active_power", "gen_speed")


@query("derived_physics", sql(HARM, "SELECT row_id, " + ", ".join(f"{e} AS {n}" for n, e in SQL_PHYSICS.items()) + " FROM harm"))
def derived_physics(spark, sf_dir):
    return features.physics_features(fleet.harmonized(spark, sf_dir)).select("row_id", *SQL_PHYSICS)


@query("yaw_error", sql(SCADA, """
SELECT row_id, CASE WHEN count(yaw_error) OVER (PARTITION BY farm_id, event_id) > 0 THEN yaw_error
  ELSE CAST(CASE WHEN abs(wind_direction - nacelle_direction) > 180 THEN 360 - abs(wind_direction - nacelle_direction)
            ELSE abs(wind_direction - nacelle_direction) END AS DOUBLE) END AS yaw_error FROM scada"""))
def yaw_error(spark, sf_dir):
    table = fleet.telemetry(spark, sf_dir).select("row_id", "farm_id", "event_id", "yaw_error", "wind_direction", "nacelle_direction")
    return harmonize.backfill_yaw_error(table).select("row_id", "yaw_error")


def _temporal(spark, sf_dir, names, **options):
    sources = [c for c in ("gearbox_oil_temp", "gen_speed", "generator_temp", "active_power", "yaw_error")
               if any(n.startswith(c) or (n, c) in (("temp_trend_24h", "gearbox_oil_temp"), ("rpm_volatility", "gen_speed")) for n in names)]
    slim = fleet.harmonized(spark, sf_dir).select("row_id", "time_stamp", "farm_id", "event_id", *sources)
    return features.temporal_features(slim, wanted=set(names), **options).select("row_id", *names)


def _temporal_sql(names, digits=None):
    return sql(HARM, "SELECT row_id, " + ", ".join(
        f"{f'round({SQL_WINDOW[n]}, {digits})' if digits else SQL_WINDOW[n]} AS {n}" for n in names) + " FROM harm")


@query("temp_trend", _temporal_sql(["temp_trend_24h"]))
def temp_trend(spark, sf_dir):
    return _temporal(spark, sf_dir, ["temp_trend_24h"])


@query("rpm_volatility", _temporal_sql(["rpm_volatility"], 6))
def rpm_volatility(spark, sf_dir):
    return _rounded(_temporal(spark, sf_dir, ["rpm_volatility"]), ["rpm_volatility"])


@query("lag_deltas", _temporal_sql(DELTA))
def lag_deltas(spark, sf_dir):
    return _temporal(spark, sf_dir, DELTA)


@query("file_histories", sql(HARM + """,
filed AS (SELECT *, 'f' || CAST(row_id % 2 AS VARCHAR) AS source_file FROM harm)""", """
SELECT row_id, """ + ", ".join(f"{SQL_WINDOW[c].replace('farm_id, event_id', 'farm_id, event_id, source_file')} AS {c}" for c in DELTA) + " FROM filed"))
def file_histories(spark, sf_dir):
    """Two files of one event: every window stays inside its file."""
    filed = fleet.harmonized(spark, sf_dir).withColumn("source_file", F.concat(F.lit("f"), (F.col("row_id") % 2).cast("string")))
    return features.temporal_features(filed, wanted=set(DELTA)).select("row_id", *DELTA)


@query("rolling_volatility", _temporal_sql(VOLATILITY, 6))
def rolling_volatility(spark, sf_dir):
    return _rounded(_temporal(spark, sf_dir, VOLATILITY), VOLATILITY)


_FEATURES_SQL = sql(FEAT, "SELECT * FROM feat")
_STD_COLUMNS = ["rpm_volatility", *VOLATILITY]


@query("features_full", _FEATURES_SQL)
def features_full(spark, sf_dir):
    return _rounded(features.derive_features(fleet.harmonized(spark, sf_dir)), _STD_COLUMNS)


@query("features_chunked", _FEATURES_SQL)
def features_chunked(spark, sf_dir):
    """The same features with every history cut into chunks of a few hundred rows."""
    return _rounded(features.derive_features(fleet.harmonized(spark, sf_dir), rows_per_chunk=400), _STD_COLUMNS)


# ---------------------------------------------------------------------------------------
# Labels and targets
# ---------------------------------------------------------------------------------------

@query("event_id_parse", sql(SCADA, """
SELECT row_id, CASE WHEN row_id % 5 = 0 THEN -1 WHEN row_id % 5 = 1 THEN CAST(asset_id || CAST(row_id % 1000 AS VARCHAR) AS BIGINT)
  ELSE CAST(row_id % 1000 AS BIGINT) END AS event_id FROM scada"""))
def event_id_parse(spark, sf_dir):
    number = (F.col("row_id") % 1000).cast("string")
    name = F.when(F.col("row_id") % 5 == 0, F.lit("comparison.csv")).when(
        F.col("row_id") % 5 == 1, F.concat(F.lit("t"), "asset_id", F.lit("_"), number, F.lit(".csv"))
    ).otherwise(F.concat(number, F.lit(".csv")))
    table = fleet.telemetry(spark, sf_dir).select("row_id", name.alias("file_name"))
    parsed = states.event_id_from_stem(states.file_stem(F.col("file_name")))
    return table.select("row_id", F.coalesce(parsed, F.lit(-1)).alias("event_id"))


@query("event_lookup", sql(HARM + FAULTS, """
SELECT s.row_id, f.event_label, f.event_start, f.event_end FROM harm s LEFT JOIN faults f ON s.farm_id = f.farm_id AND s.event_id = f.event_id"""))
def event_lookup(spark, sf_dir):
    rows = fleet.harmonized(spark, sf_dir).select("row_id", "farm_id", "event_id")
    return labeling.attach_events(rows, fleet.faults(spark, sf_dir)).select("row_id", *labeling.EVENT_COLUMNS)


@query("state_labels", sql(HARM + _labels("harm", 0), f"SELECT {LABEL_OUT} FROM lab"))
def state_labels(spark, sf_dir):
    return fleet.labelled(spark, sf_dir, 0.0).select(*LABEL_OUT.split(", "))


@query("state_labels_buffered", sql(LAB, f"SELECT {LABEL_OUT} FROM lab"))
def state_labels_buffered(spark, sf_dir):
    return fleet.labelled(spark, sf_dir).select(*LABEL_OUT.split(", "))


def _target_query(name, codes):
    @query(f"target_{name[4:]}", sql(LAB, f"""
SELECT row_id, CAST(CASE WHEN state_label = 5 THEN NULL WHEN state_label IN ({codes}) THEN 1 ELSE 0 END AS DOUBLE) AS target FROM lab"""))
    def target(spark, sf_dir):
        states_wanted = config.experiment(name).positive_states
        return labeling.binary_target(fleet.labelled(spark, sf_dir), states_wanted).select("row_id", "target")


_target_query("pre_24h", "3, 4")
_target_query("pre_48h", "2, 3, 4")
_target_query("pre_72h", "1, 2, 3, 4")


@query("target_isin", sql(LAB, "SELECT row_id, CAST(CASE WHEN state_name IN ('pre_0_24h', 'event_occurring') THEN 1 ELSE 0 END AS INTEGER) AS target FROM lab"))
def target_isin(spark, sf_dir):
    return labeling.membership_target(fleet.labelled(spark, sf_dir), config.experiment("pre_24h").positive_states).select("row_id", "target")


@query("experiment_dataset", sql(LAB, """
SELECT row_id, state_label, CAST(CASE WHEN state_label IN (3, 4) THEN 1 ELSE 0 END AS DOUBLE) AS target FROM lab WHERE state_label <> 5"""))
def experiment_dataset(spark, sf_dir):
    return labeling.experiment_dataset(fleet.labelled(spark, sf_dir), config.experiment("pre_24h")).select("row_id", "state_label", "target")


@query("group_id", sql(SCADA, "SELECT row_id, farm_id || '__' || asset_id AS group_id FROM scada"))
def group_id(spark, sf_dir):
    table = fleet.telemetry(spark, sf_dir)
    return table.select("row_id", states.turbine_key(F.col("farm_id"), F.col("asset_id")).alias("group_id"))


@query("group_meta", sql(SCADA, "SELECT farm_id || '__' || asset_id AS group_id, farm_id, count(*) AS n_rows FROM scada GROUP BY ALL"))
def group_meta(spark, sf_dir):
    return splits.turbine_groups(fleet.telemetry(spark, sf_dir))


# ---------------------------------------------------------------------------------------
# Feature selection
# ---------------------------------------------------------------------------------------

_FEATURE_NAMES = [*_STANDARD, "temp_delta_gearbox", "temp_divergence", "power_efficiency", "vibration_magnitude"]


def _physics_table(spark, sf_dir):
    physics = features.physics_features(fleet.harmonized(spark, sf_dir))
    filled = features.fill_missing(physics, _FEATURE_NAMES)
    return labeling.label_states(filled, fleet.faults(spark, sf_dir), buffer_before_hours=6, buffer_after_hours=6)


_PHYS = HARM + ",\nphys AS (SELECT time_stamp, farm_id, asset_id, event_id, row_id, " + ", ".join(
    f"coalesce({SQL_PHYSICS.get(c, c)}, 0) AS {c}" for c in _FEATURE_NAMES) + " FROM harm)" + _labels("phys", 6)


@query("feature_selection", sql(_PHYS, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c}) AS minimum, max({c}) AS maximum FROM lab" for c in _FEATURE_NAMES)))
def feature_selection(spark, sf_dir):
    table = _physics_table(spark, sf_dir)
    chosen = selection.feature_columns(table)
    ranges = table.agg(*[F.min(c).alias(f"lo_{c}") for c in chosen], *[F.max(c).alias(f"hi_{c}") for c in chosen])
    return ranges.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("minimum"), F.col(f"hi_{c}").alias("maximum")) for c in chosen
    ])))


@query("feature_matrix", sql(_PHYS, f"SELECT {', '.join(_FEATURE_NAMES)} FROM lab"))
def feature_matrix(spark, sf_dir):
    return selection.feature_matrix(_physics_table(spark, sf_dir))


@query("prepare_xy", sql(_PHYS, f"SELECT row_id, {', '.join(_FEATURE_NAMES)}, target FROM lab"))
def prepare_xy(spark, sf_dir):
    return selection.prepare_xy(_physics_table(spark, sf_dir))


# ---------------------------------------------------------------------------------------
# Data quality
# ---------------------------------------------------------------------------------------

@query("missingness", sql(LAB, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS missing_fraction FROM lab"
    for c in [*_STANDARD, "event_label", "target"])))
def missingness(spark, sf_dir):
    return quality.missingness(fleet.labelled(spark, sf_dir), [*_STANDARD, "event_label", "target"])


@query("state_distribution", sql(LAB, 'SELECT state_name, count(*) AS "count", CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lab) AS fraction FROM lab GROUP BY state_name'))
def state_distribution(spark, sf_dir):
    return quality.distribution(fleet.labelled(spark, sf_dir), "state_name")


@query("target_distribution", sql(LAB, 'SELECT target AS target_value, count(*) AS "count", CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lab) AS fraction FROM lab GROUP BY target'))
def target_distribution(spark, sf_dir):
    return quality.distribution(fleet.labelled(spark, sf_dir), "target", "target_value")


@query("farm_summary", sql(LAB, """
SELECT farm_id, count(*) AS n_rows, count(DISTINCT asset_id) AS n_assets, sum(coalesce(target, 0)) AS positive_target_rows,
       CAST(sum(CASE WHEN is_excluded_buffer THEN 1 ELSE 0 END) AS BIGINT) AS excluded_buffer_rows FROM lab GROUP BY farm_id"""))
def farm_summary(spark, sf_dir):
    return quality.farm_summary(fleet.labelled(spark, sf_dir))


@query("dataset_summary", sql(LAB, """
SELECT count(*) AS rows, 25 AS columns, count(DISTINCT farm_id) AS unique_farms, count(DISTINCT asset_id) AS unique_turbines,
       count(DISTINCT event_id) AS unique_events, avg(target) AS positive_rate FROM lab"""))
def dataset_summary(spark, sf_dir):
    return quality.dataset_summary(fleet.labelled(spark, sf_dir))


@query("dataset_profile", sql(LAB, """
SELECT count(*) AS rows, 25 AS columns, count(DISTINCT farm_id) AS n_farms, count(DISTINCT asset_id) AS n_assets,
       min(time_stamp) AS min_time, max(time_stamp) AS max_time FROM lab"""))
def dataset_profile(spark, sf_dir):
    return quality.dataset_profile(fleet.labelled(spark, sf_dir))


@query("target_counts", sql(LAB, """
SELECT count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 0) AS negatives,
       count(*) FILTER (WHERE target IS NULL) AS missing FROM lab"""))
def target_counts(spark, sf_dir):
    return quality.target_counts(fleet.labelled(spark, sf_dir))


_GROUPS = {"standard_features": _STANDARD, "named_derived_features": list(config.DERIVED_FEATURES),
           "metadata_columns": [*config.IDENTITY_COLUMNS, *config.LABEL_COLUMNS]}
_PHYS_NUMERIC = {*_FEATURE_NAMES, "event_id", "state_label", "target"}
_PHYS_ALL = _PHYS_NUMERIC | {*config.IDENTITY_COLUMNS, *config.LABEL_COLUMNS}


def _coverage_sql():
    lines = []
    for group, names in _GROUPS.items():
        for c in names:
            if c not in _PHYS_ALL:
                lines.append(f"SELECT '{c}' AS \"column\", '{group}' AS category, FALSE AS is_present, CAST(0 AS BIGINT) AS non_null, CAST(0 AS BIGINT) AS non_zero")
                continue
            nonzero = f"count(*) FILTER (WHERE {c} <> 0)" if c in _PHYS_NUMERIC else f"count({c})"
            lines.append(f"SELECT '{c}' AS \"column\", '{group}' AS category, TRUE AS is_present, count({c}) AS non_null, {nonzero} AS non_zero FROM lab")
    return " UNION ALL ".join(lines)


@query("feature_coverage", sql(_PHYS, _coverage_sql()))
def feature_coverage(spark, sf_dir):
    return quality.feature_coverage(_physics_table(spark, sf_dir), _GROUPS)


@query("schema_validation", sql(_PHYS, f"""
SELECT category, count(*) AS expected, count(*) FILTER (WHERE is_present) AS present, count(*) FILTER (WHERE NOT is_present) AS missing,
       count(*) FILTER (WHERE non_null > 0) AS with_values FROM ({_coverage_sql()}) GROUP BY category"""))
def schema_validation(spark, sf_dir):
    return quality.schema_validation(_physics_table(spark, sf_dir), _GROUPS)


@query("label_validation", sql(LAB, """
SELECT 'unknown_state' AS rule, count(*) FILTER (WHERE state_label NOT IN (0, 1, 2, 3, 4, 5)) AS violations FROM lab
UNION ALL SELECT 'non_binary_target', count(*) FILTER (WHERE NOT is_excluded_buffer AND target NOT IN (0, 1)) FROM lab"""))
def label_validation(spark, sf_dir):
    return quality.label_validation(fleet.labelled(spark, sf_dir))


@query("target_correlation", sql(_PHYS, "SELECT feature, round(correlation, 6) AS correlation FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, target) AS correlation FROM lab" for c in _FEATURE_NAMES)
    + ") ORDER BY correlation DESC NULLS LAST, feature LIMIT 15"))
def target_correlation(spark, sf_dir):
    return _rounded(quality.target_correlation(_physics_table(spark, sf_dir)), ["correlation"])


@query("raw_wind_summary", sql(SCADA, """
SELECT farm_id, count(wind_speed) AS n_values, min(wind_speed) AS minimum, quantile_cont(wind_speed, 0.25) AS q1,
       quantile_cont(wind_speed, 0.5) AS median, quantile_cont(wind_speed, 0.75) AS q3, max(wind_speed) AS maximum
FROM scada WHERE wind_speed IS NOT NULL GROUP BY farm_id"""))
def raw_wind_summary(spark, sf_dir):
    return quality.box_summary(fleet.telemetry(spark, sf_dir).na.drop(subset=["wind_speed"]), "farm_id", "wind_speed", rows_per_chunk=100_000)


@query("class_weights", sql(LAB, """
SELECT y AS class, n AS n_rows, CAST(total AS DOUBLE) / (2 * CAST(n AS DOUBLE)) AS balanced_weight,
       CASE WHEN y = 1 THEN CAST(total - n AS DOUBLE) / n ELSE CAST(1 AS DOUBLE) END AS boosting_weight
FROM (SELECT CAST(target AS INTEGER) AS y, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM lab WHERE target IS NOT NULL GROUP BY 1)"""))
def class_weights(spark, sf_dir):
    return quality.class_weights(fleet.labelled(spark, sf_dir))


# ---------------------------------------------------------------------------------------
# Splits
# ---------------------------------------------------------------------------------------

@query("event_bounds", sql(SCADA, "SELECT farm_id, event_id, min(time_stamp) AS first_time, max(time_stamp) AS last_time, count(*) AS n_rows FROM scada GROUP BY ALL"))
def event_bounds(spark, sf_dir):
    return splits.event_bounds(fleet.telemetry(spark, sf_dir))


_EVENT_SPLIT = """,
bounds AS (SELECT farm_id, event_id, min(time_stamp) AS first_time FROM scada GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY first_time, event_id, farm_id) - 1 AS nth, count(*) OVER () AS n FROM bounds),
assigned AS (SELECT farm_id, event_id, CASE WHEN nth < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN nth < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM placed)"""


@query("split_event_time", sql(SCADA + _EVENT_SPLIT, "SELECT row_id, split FROM scada JOIN assigned USING (farm_id, event_id)"))
def split_event_time(spark, sf_dir):
    return splits.event_time_split(fleet.telemetry(spark, sf_dir)).select("row_id", "split")


def _positional(order: str, partition: str = "") -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    over = f"PARTITION BY {partition}" if partition else ""
    return f"""
SELECT row_id, CASE WHEN nth < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN nth < floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT row_id, row_number() OVER ({by}ORDER BY {order}) - 1 AS nth, count(*) OVER ({over}) AS n FROM scada)"""


@query("split_global_time", sql(SCADA, _positional("time_stamp, row_id")))
def split_global_time(spark, sf_dir):
    return splits.global_time_split(fleet.telemetry(spark, sf_dir)).select("row_id", "split")


@query("split_turbine_time", sql(SCADA, _positional("time_stamp, row_id", "farm_id, asset_id")))
def split_turbine_time(spark, sf_dir):
    return splits.turbine_time_split(fleet.telemetry(spark, sf_dir)).select("row_id", "split")


@query("turbine_rank", sql(SCADA, "SELECT row_id, row_number() OVER (PARTITION BY farm_id, asset_id ORDER BY time_stamp, row_id) AS \"rank\" FROM scada"))
def turbine_rank(spark, sf_dir):
    """Exact per-turbine row numbers with every history cut into small chunks."""
    slim = fleet.telemetry(spark, sf_dir).select("row_id", "time_stamp", "farm_id", "asset_id")
    return with_rank(slim, ["farm_id", "asset_id"], ["time_stamp", "row_id"], rows_per_chunk=300).select("row_id", "rank")


@query("split_turbine_holdout", sql(SCADA + """,
turbines AS (SELECT DISTINCT farm_id, farm_id || '__' || asset_id AS g FROM scada),
farms AS (SELECT farm_id, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM turbines GROUP BY farm_id),
shares AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * total) AS tested, ceil(CAST(0.2 AS DOUBLE) * total) * n / total AS exact FROM farms),
slots AS (SELECT farm_id, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, farm_id)
  <= tested - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS slots FROM shares),
held AS (SELECT g, CASE WHEN row_number() OVER (PARTITION BY t.farm_id ORDER BY md5('42#' || g)) <= slots THEN 'test' ELSE 'train' END AS split
  FROM turbines t JOIN slots s ON t.farm_id = s.farm_id)""", "SELECT row_id, split FROM scada JOIN held ON g = farm_id || '__' || asset_id"))
def split_turbine_holdout(spark, sf_dir):
    return splits.turbine_holdout_split(fleet.telemetry(spark, sf_dir)).select("row_id", "split")


@query("split_random", """
SELECT row_id, CASE WHEN nth <= n - held THEN 'train' WHEN nth <= n - ceil(held * CAST(0.5 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, ceil(n * (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE))) AS held
      FROM (SELECT event_id AS row_id, row_number() OVER (ORDER BY md5('42#' || CAST(event_id AS VARCHAR)), event_id) AS nth, count(*) OVER () AS n FROM events))""")
def split_random(spark, sf_dir):
    return splits.random_split(fleet.telemetry(spark, sf_dir)).select("row_id", "split")


@query("group_kfold", "WITH RECURSIVE " + SCADA.strip() + """,
sized AS (SELECT farm_id || '__' || asset_id AS g, count(*) AS n FROM scada GROUP BY ALL),
ordered AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS step FROM sized),
fold_steps AS (
  SELECT 0 AS step, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS g, NULL::BIGINT AS fold
  UNION ALL
  SELECT o.step, list_transform(p.loads, lambda x, i: CASE WHEN i = list_position(p.loads, list_min(p.loads)) THEN x + o.n ELSE x END),
         o.g, list_position(p.loads, list_min(p.loads)) - 1
  FROM fold_steps p JOIN ordered o ON o.step = p.step + 1)
SELECT row_id, CAST(fold AS INTEGER) AS fold FROM scada JOIN fold_steps ON g = farm_id || '__' || asset_id""")
def group_kfold(spark, sf_dir):
    table = fleet.telemetry(spark, sf_dir).withColumn("target", F.lit(0))
    return splits.group_kfold(table).select("row_id", "fold")


@query("refit_rows", sql(SCADA + _EVENT_SPLIT, "SELECT row_id FROM scada JOIN assigned USING (farm_id, event_id) WHERE split IN ('train', 'val')"))
def refit_rows(spark, sf_dir):
    return splits.parts(splits.event_time_split(fleet.telemetry(spark, sf_dir)), "train", "val").select("row_id")


@query("split_sizes", sql(LAB + _EVENT_SPLIT.replace("FROM scada", "FROM lab"), """
SELECT split, count(*) AS rows, avg(target) AS positive_rate FROM lab JOIN assigned USING (farm_id, event_id) GROUP BY split"""))
def split_sizes(spark, sf_dir):
    return quality.split_sizes(splits.event_time_split(fleet.labelled(spark, sf_dir)))


# ---------------------------------------------------------------------------------------
# Metrics on a deterministic score
# ---------------------------------------------------------------------------------------

_CUT = """,
counts AS (SELECT count(*) FILTER (WHERE y_true = 0 AND y_prob < $t) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_prob >= $t) AS fp,
                  count(*) FILTER (WHERE y_true = 1 AND y_prob < $t) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_prob >= $t) AS tp FROM sc)"""
_AUC = """,
per_score AS (SELECT y_prob, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg FROM sc GROUP BY y_prob),
running AS (SELECT *, sum(pos) OVER (ORDER BY y_prob DESC) AS tpc, sum(neg) OVER (ORDER BY y_prob DESC) AS fpc, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM per_score),
areas AS (SELECT round(sum((tpc - pos / 2) * neg / (p * n)), 6) AS roc_auc, round(sum(pos / p * tpc / (tpc + fpc)), 6) AS pr_auc FROM running)"""


def _r(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE CAST(0 AS DOUBLE) END"


_HEAD = {
    "precision": _r("tp", "tp + fp"), "recall": _r("tp", "tp + fn"), "f1": _r("2 * tp", "2 * tp + fp + fn"),
    "balanced_accuracy": f"({_r('tp', 'tp + fn')} + {_r('tn', 'tn + fp')}) / 2",
    "accuracy": _r("tp + tn", "tp + tn + fp + fn"), "prevalence": _r("tp + fn", "tp + tn + fp + fn"),
}
_RATES = {
    "specificity": _r("tn", "tn + fp"), "negative_predictive_value": _r("tn", "tn + fn"),
    "false_positive_rate": _r("fp", "fp + tn"), "false_negative_rate": _r("fn", "fn + tp"),
    "support_negative": "tn + fp", "support_positive": "tp + fn",
}


def _aliased(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


def _auc_rounded(df):
    return _rounded(df, ["roc_auc", "pr_auc"])


@query("predict_at_threshold", sql(SCORED, "SELECT row_id, y_prob, CASE WHEN y_prob >= CAST(0.3 AS DOUBLE) THEN 1 ELSE 0 END AS y_pred FROM sc"))
def predict_at_threshold(spark, sf_dir):
    return metrics.at_threshold(fleet.scores(spark, sf_dir), 0.3).select("row_id", "y_prob", "y_pred")


@query("metric_input_checks", sql(SCORED, """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE y_true IS NULL) AS null_labels, count(*) FILTER (WHERE y_true NOT IN (0, 1)) AS non_binary_labels,
       count(*) FILTER (WHERE y_prob IS NULL) AS null_scores FROM sc"""))
def metric_input_checks(spark, sf_dir):
    table = fleet.scores(spark, sf_dir)
    metrics.check_inputs(table, "y_true", "y_prob")
    return metrics.input_violations(table, "y_true", "y_prob")


@query("confusion_metrics", sql(SCORED + _CUT.replace("$t", "CAST(0.5 AS DOUBLE)"), f"SELECT tn, fp, fn, tp, {_aliased(_RATES)} FROM counts"))
def confusion_metrics(spark, sf_dir):
    return metrics.confusion_metrics(metrics.at_threshold(fleet.scores(spark, sf_dir), 0.5))


@query("binary_metrics", sql(SCORED + _CUT.replace("$t", "CAST(0.5 AS DOUBLE)") + _AUC,
                             f"SELECT tn, fp, fn, tp, {_aliased(_HEAD)}, {_aliased(_RATES)}, (SELECT roc_auc FROM areas) AS roc_auc, (SELECT pr_auc FROM areas) AS pr_auc FROM counts"))
def binary_metrics(spark, sf_dir):
    return _auc_rounded(metrics.binary_metrics(metrics.at_threshold(fleet.scores(spark, sf_dir), 0.5), score="y_prob"))


@query("eval_at_threshold", sql(SCORED + _CUT.replace("$t", "CAST(0.25 AS DOUBLE)") + _AUC,
                                f"SELECT tn, fp, fn, tp, {_aliased(_HEAD)}, {_aliased(_RATES)}, (SELECT roc_auc FROM areas) AS roc_auc, (SELECT pr_auc FROM areas) AS pr_auc, CAST(0.25 AS DOUBLE) AS threshold FROM counts"))
def eval_at_threshold(spark, sf_dir):
    return _auc_rounded(metrics.evaluate_at_threshold(fleet.scores(spark, sf_dir), 0.25))


@query("roc_auc", sql(SCORED + _AUC, "SELECT roc_auc FROM areas"))
def roc_auc(spark, sf_dir):
    return _auc_rounded(metrics.auc(fleet.scores(spark, sf_dir))).select("roc_auc")


@query("pr_auc", sql(SCORED + _AUC, "SELECT pr_auc FROM areas"))
def pr_auc(spark, sf_dir):
    return _auc_rounded(metrics.auc(fleet.scores(spark, sf_dir))).select("pr_auc")


@query("classification_report", sql(SCORED + _CUT.replace("$t", "CAST(0.5 AS DOUBLE)") + f""",
rep AS (SELECT tn + fp AS neg, tp + fn AS pos, tn + fp + fn + tp AS total, {_r('tn', 'tn + fn')} AS p0, {_r('tn', 'tn + fp')} AS r0, {_r('2 * tn', '2 * tn + fn + fp')} AS f0,
  {_r('tp', 'tp + fp')} AS p1, {_r('tp', 'tp + fn')} AS r1, {_r('2 * tp', '2 * tp + fp + fn')} AS f1, {_r('tp + tn', 'tp + tn + fp + fn')} AS acc FROM counts)""", """
SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1_score, CAST(neg AS DOUBLE) AS support FROM rep
UNION ALL SELECT '1', p1, r1, f1, CAST(pos AS DOUBLE) FROM rep
UNION ALL SELECT 'accuracy', acc, acc, acc, CAST(total AS DOUBLE) FROM rep
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, CAST(total AS DOUBLE) FROM rep
UNION ALL SELECT 'weighted avg', (p0 * neg + p1 * pos) / total, (r0 * neg + r1 * pos) / total, (f0 * neg + f1 * pos) / total, CAST(total AS DOUBLE) FROM rep"""))
def classification_report(spark, sf_dir):
    return metrics.classification_report(metrics.at_threshold(fleet.scores(spark, sf_dir), 0.5))


_GROUPED = """,
parts AS (SELECT row_id % 5 AS part, y_true, y_prob FROM sc),
counts AS (SELECT part, count(*) FILTER (y_true = 0 AND y_prob < 0.5) AS tn, count(*) FILTER (y_true = 0 AND y_prob >= 0.5) AS fp,
  count(*) FILTER (y_true = 1 AND y_prob < 0.5) AS fn, count(*) FILTER (y_true = 1 AND y_prob >= 0.5) AS tp FROM parts GROUP BY part),
distinct_scores AS (SELECT part, y_prob, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM parts GROUP BY part, y_prob),
ranked AS (SELECT part, pos, neg, sum(pos) OVER w AS above, sum(neg) OVER w AS wrong FROM distinct_scores WINDOW w AS (PARTITION BY part ORDER BY y_prob DESC)),
areas AS (SELECT part, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum((above - pos / 2) * neg) / (sum(pos) * sum(neg)), 6) END AS roc_auc,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * above / (above + wrong)) / sum(pos), 6) END AS pr_auc FROM ranked GROUP BY part)"""


@query("metrics_by_group", sql(SCORED + _GROUPED, f"SELECT part, tn, fp, fn, tp, {_aliased(_HEAD)}, {_aliased(_RATES)}, roc_auc, pr_auc FROM counts JOIN areas USING (part)"))
def metrics_by_group(spark, sf_dir):
    """The metric bundle of five parts from the same passes."""
    parts = metrics.at_threshold(fleet.scores(spark, sf_dir), 0.5).withColumn("part", F.col("row_id") % 5)
    return _auc_rounded(metrics.metrics_by_group(parts, ["part"], score="y_prob"))


_GRID = ", ".join(f"({t!r}::DOUBLE)" for t in metrics.default_thresholds())
_SWEEP = _AUC + f""",
grid AS (SELECT * FROM (VALUES {_GRID}) AS v(threshold)),
swept AS (SELECT threshold, count(*) FILTER (WHERE y_true = 1 AND y_prob >= threshold) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_prob >= threshold) AS fp,
  count(*) FILTER (WHERE y_true = 0 AND y_prob < threshold) AS tn, count(*) FILTER (WHERE y_true = 1 AND y_prob < threshold) AS fn FROM sc CROSS JOIN grid GROUP BY threshold),
sweep AS (SELECT threshold, {_aliased({k: v for k, v in {**_HEAD, **_RATES}.items() if k in ('precision', 'recall', 'f1', 'balanced_accuracy', 'specificity', 'false_positive_rate', 'false_negative_rate')})},
  tp, fp, tn, fn, tp + fn AS support_positive, tn + fp AS support_negative, (SELECT roc_auc FROM areas) AS roc_auc, (SELECT pr_auc FROM areas) AS pr_auc FROM swept)"""


@query("threshold_sweep", sql(SCORED + _SWEEP, "SELECT * FROM sweep"))
def threshold_sweep(spark, sf_dir):
    return _auc_rounded(metrics.threshold_sweep(fleet.scores(spark, sf_dir)))


@query("best_threshold", sql(SCORED + _SWEEP, """
SELECT *, 'f1' AS optimize_for, f1 AS best_score FROM sweep ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1"""))
def best_threshold(spark, sf_dir):
    return _auc_rounded(metrics.best_threshold(fleet.scores(spark, sf_dir)))


@query("top_thresholds", sql(SCORED + _SWEEP, "SELECT threshold, f1, recall, precision FROM sweep ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 15"))
def top_thresholds(spark, sf_dir):
    sweep = metrics.threshold_sweep(fleet.scores(spark, sf_dir), with_auc=False)
    return metrics.top_thresholds(sweep).select("threshold", "f1", "recall", "precision")


# ---------------------------------------------------------------------------------------
# Timelines
# ---------------------------------------------------------------------------------------

@query("event_index", sql(LAB, """
SELECT DISTINCT farm_id, asset_id, event_id, event_label, event_start, event_end,
  'farm_' || farm_id || '_turbine_' || asset_id || '_event_' || CAST(event_id AS VARCHAR) || '_' || replace(replace(event_label, ' ', '_'), '/', '_') || '.png' AS file_name
FROM lab WHERE event_start IS NOT NULL"""))
def event_index(spark, sf_dir):
    return timeline.sorted_event_index(fleet.labelled(spark, sf_dir))


def _z(signal: str) -> str:
    over = "OVER (PARTITION BY farm_id, asset_id, event_id)"
    std = f"stddev_samp({signal}) {over}"
    return f"round(CASE WHEN {std} IS NULL OR {std} = 0 THEN 0 ELSE ({signal} - avg({signal}) {over}) / {std} END, 6) + 0.0 AS {signal}_z"


_TIMELINE = """
inside AS (SELECT s.row_id, s.time_stamp, s.farm_id, s.asset_id, f.event_id, f.event_label, f.event_start, f.event_end, $signals
  FROM $source s JOIN faults f ON s.farm_id = f.farm_id AND s.asset_id = f.asset_id
  WHERE time_stamp BETWEEN event_start - INTERVAL 168 HOUR AND event_start + INTERVAL 24 HOUR)"""
_HOURS = "CAST(date_diff('microsecond', event_start, time_stamp) AS DOUBLE) / CAST(3.6e9 AS DOUBLE) AS hours_from_event_start"


@query("event_timeline", sql(HARM + FAULTS + "," + _TIMELINE.replace("$signals", "vibration_raw, nacelle_temp, gen_speed").replace("$source", "harm"),
                             f"SELECT *, {_HOURS}, {_z('vibration_raw')}, {_z('nacelle_temp')}, {_z('gen_speed')} FROM inside"))
def event_timeline(spark, sf_dir):
    signals = ["vibration_raw", "nacelle_temp", "gen_speed"]
    lines = timeline.event_timeline(fleet.harmonized(spark, sf_dir), fleet.faults(spark, sf_dir), signals, keep=("row_id",))
    return _rounded(lines, [f"{s}_z" for s in signals])


@query("event_timeline_repeated", _ORACLE["event_timeline"])
def event_timeline_repeated(spark, sf_dir):
    """Events listed twice give the same timelines."""
    signals = ["vibration_raw", "nacelle_temp", "gen_speed"]
    events = fleet.faults(spark, sf_dir)
    lines = timeline.event_timeline(fleet.harmonized(spark, sf_dir), events.unionByName(events), signals, keep=("row_id",))
    return _rounded(lines, [f"{s}_z" for s in signals])


@query("prediction_timeline", sql(SCADA + FAULTS + "," + SCORED + """,
predicted AS (SELECT s.row_id, time_stamp, farm_id, asset_id, y_prob AS y_proba FROM scada s JOIN sc ON s.row_id = sc.row_id),"""
                                  + _TIMELINE.replace("$signals", "y_proba").replace("$source", "predicted"),
                                  f"SELECT time_stamp, farm_id, asset_id, event_id, y_proba, {_HOURS}, {_z('y_proba')}, CASE WHEN y_proba >= CAST(0.78 AS DOUBLE) THEN 1 ELSE 0 END AS y_pred FROM inside"))
def prediction_timeline(spark, sf_dir):
    lines = timeline.prediction_timeline(fleet.predictions(spark, sf_dir), fleet.faults(spark, sf_dir))
    return _rounded(lines, ["y_proba_z"]).select(
        "time_stamp", "farm_id", "asset_id", "event_id", "y_proba", "hours_from_event_start", "y_proba_z", "y_pred"
    )


@query("asset_failure_band", sql(LAB + """,
marked AS (SELECT farm_id, asset_id, time_stamp, target, row_number() OVER (PARTITION BY farm_id, asset_id ORDER BY time_stamp, row_id)
  - row_number() OVER (PARTITION BY farm_id, asset_id, coalesce(target, -1) = 1 ORDER BY time_stamp, row_id) AS run FROM lab)""", """
SELECT farm_id, asset_id, min(time_stamp) AS band_start, max(time_stamp) AS band_end, count(*) AS n_rows
FROM marked WHERE target = 1 GROUP BY farm_id, asset_id, run"""))
def asset_failure_band(spark, sf_dir):
    return timeline.failure_bands(fleet.labelled(spark, sf_dir))


# ---------------------------------------------------------------------------------------
# Models, with the settings of the registry
# ---------------------------------------------------------------------------------------

def _prepared(spark, sf_dir):
    return experiments.prepare(fleet.processed(spark, sf_dir), config.experiment("pre_72h"))


def _trained(spark, sf_dir, name):
    table, columns = _prepared(spark, sf_dir)
    return experiments.run_model(name, table, columns, config.experiment("pre_72h")), table


def _train_query(name, model):
    @query(name)
    def train(spark, sf_dir):
        run, _ = _trained(spark, sf_dir, model)
        return experiments.snapshot(run)


_train_query("train_logistic", "logistic")
_train_query("train_rf", "rf")
_train_query("train_gbt", "gbt")


@query("score_table")
def score_table(spark, sf_dir):
    run, table = _trained(spark, sf_dir, "logistic")
    return run.model.predict(splits.parts(table, "test")).select("label", "y_prob", "y_pred")


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return _trained(spark, sf_dir, "rf")[0].importance()


@query("top_features")
def top_features(spark, sf_dir):
    return training.top_features(_trained(spark, sf_dir, "logistic")[0].importance(), 20)


@query("tournament")
def tournament(spark, sf_dir):
    table, columns = _prepared(spark, sf_dir)
    return experiments.tournament(table, columns, config.experiment("pre_72h"))[0]


@query("leaderboard")
def leaderboard(spark, sf_dir):
    output = scratch_folder(spark, "run")
    return experiments.run_experiment(fleet.processed(spark, sf_dir), "pre_24h", output=output)[0]


@query("target_checks", sql(LAB, """SELECT count(*) FILTER (target = 0) AS neg, count(*) FILTER (target = 1) AS pos,
  count(*) FILTER (target IS NULL) AS nulls, count(*) AS n FROM lab"""))
def target_checks(spark, sf_dir):
    """What the trainer counts before it accepts a target."""
    return training.target_counts(fleet.labelled(spark, sf_dir), "target")


@query("aligned_matrices", sql(PROC + _EVENT_SPLIT.replace("FROM scada", "FROM kept"), """
SELECT split, label, count(*) AS n_rows, CAST($n AS INTEGER) AS n_features FROM kept JOIN assigned USING (farm_id, event_id) GROUP BY split, label""".replace("$n", str(len(_STANDARD) + len(_COMPUTED)))).replace(
    ",\nbounds", ",\nkept AS (SELECT *, CASE WHEN state_label IN (2, 3, 4) THEN 1 ELSE 0 END AS label FROM lab WHERE state_label <> 5),\nbounds", 1))
def aligned_matrices(spark, sf_dir):
    """Vectors and labels of the parts, as training reads them."""
    table, _ = experiments.prepare(fleet.processed(spark, sf_dir, 6.0), config.experiment("pre_48h"))
    sized = table.withColumn("n_features", F.size(vector_to_array("features")))
    return sized.groupBy("split", "label", "n_features").agg(F.count(F.lit(1)).alias("n_rows"))


# Models of one binary input have answers in closed form: with balanced weights the chance of class 1 is a ratio of
# shares, and one boosting step gives the sigmoid of twice the weighted mean of -1 and 1 in each leaf.
_ONE_BIT = SCORED + """,
cells AS (SELECT CAST(y_prob >= 0.5 AS INTEGER) AS bit, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM sc GROUP BY 1),
totals AS (SELECT sum(pos) AS p, sum(neg) AS n FROM cells)"""
_BALANCED = "SELECT bit, CAST(pos + neg AS BIGINT) AS n_rows, round((pos / p) / (pos / p + neg / n), 3) AS y_prob FROM cells, totals"
_BOOSTED = """SELECT bit, CAST(pos + neg AS BIGINT) AS n_rows,
  round(1 / (1 + exp(-2 * (n / p * pos - neg) / (n / p * pos + neg))), 3) AS y_prob FROM cells, totals"""


def _one_bit_query(name, select, model, **params):
    @query(name, sql(_ONE_BIT, select))
    def fit(spark, sf_dir):
        rows = fleet.scores(spark, sf_dir).selectExpr("int(y_prob >= 0.5) AS bit", "y_true AS target")
        table = selection.assemble(rows, ["bit"], keep=("bit",))
        scored = training.FaultModel(model, params).fit(table).score(table)
        return scored.groupBy("bit").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("y_prob"), 3).alias("y_prob"))


# The scores of the one-bit tree in place of those of the fleet.
_TREE_SCORES = SCORED.replace("sc AS", "raw AS") + """,
cells AS (SELECT CAST(y_prob >= 0.5 AS INTEGER) AS bit, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM raw GROUP BY 1),
totals AS (SELECT sum(pos) AS p, sum(neg) AS n FROM cells),
sc AS (SELECT row_id, y_true, (pos / p) / (pos / p + neg / n) AS y_prob FROM raw JOIN cells ON bit = CAST(raw.y_prob >= 0.5 AS INTEGER), totals)"""


def _one_bit_tree(spark, sf_dir):
    rows = fleet.scores(spark, sf_dir).selectExpr("int(y_prob >= 0.5) AS bit", "y_true AS target")
    table = selection.assemble(rows, ["bit"], keep=("bit",))
    return training.FaultModel("rf", {"n_estimators": 1, "max_depth": 1, "bootstrap": False}).fit(table), table


@query("one_bit_predictions", sql(_TREE_SCORES, "SELECT y_true AS label, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred, count(*) AS n_rows FROM sc GROUP BY 1, 2"))
def one_bit_predictions(spark, sf_dir):
    model, table = _one_bit_tree(spark, sf_dir)
    return model.predict(table, 0.5).groupBy(F.col("label").cast("int").alias("label"), "y_pred").agg(F.count(F.lit(1)).alias("n_rows"))


@query("one_bit_tuning", sql(_TREE_SCORES + _SWEEP, """
SELECT threshold, f1, recall, precision, roc_auc, pr_auc FROM sweep ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1"""))
def one_bit_tuning(spark, sf_dir):
    """The threshold that tuning picks, with its metrics."""
    model, table = _one_bit_tree(spark, sf_dir)
    model.tune(table)
    row = tuple(float(model.tuning[m]) for m in ("threshold", "f1", "recall", "precision", "roc_auc", "pr_auc"))
    return _auc_rounded(spark.createDataFrame([row], "threshold double, f1 double, recall double, precision double, roc_auc double, pr_auc double"))


@query("one_bit_evaluation", sql(_TREE_SCORES + _CUT.replace("$t", "CAST(0.5 AS DOUBLE)") + _AUC,
                                 f"SELECT {_aliased({k: v for k, v in {**_HEAD, **_RATES}.items() if k in ('precision', 'recall', 'f1', 'balanced_accuracy', 'specificity')})}, (SELECT roc_auc FROM areas) AS roc_auc, (SELECT pr_auc FROM areas) AS pr_auc, CAST(0.5 AS DOUBLE) AS threshold FROM counts"))
def one_bit_evaluation(spark, sf_dir):
    model, table = _one_bit_tree(spark, sf_dir)
    return _auc_rounded(model.evaluate(table, 0.5))


@query("one_bit_importance", sql(_ONE_BIT + """,
odds AS (SELECT max(CASE WHEN bit = 1 THEN ln((pos / p) / (neg / n)) END) - max(CASE WHEN bit = 0 THEN ln((pos / p) / (neg / n)) END) AS gain FROM cells, totals),
spread AS (SELECT stddev_pop(CAST(y_prob >= 0.5 AS INTEGER)) AS s FROM sc)""",
                                 "SELECT 'bit' AS feature, round(gain * s, 2) AS coefficient, round(abs(gain * s), 2) AS abs_importance FROM odds, spread"))
def one_bit_importance(spark, sf_dir):
    """The linear model's coefficient on the scaled input, in closed form: the log odds ratio times the input's deviation."""
    rows = fleet.scores(spark, sf_dir).selectExpr("int(y_prob >= 0.5) AS bit", "y_true AS target")
    model = training.FaultModel("logistic", {"C": 1e6}).fit(selection.assemble(rows, ["bit"]))
    return _rounded(training.top_features(model.importance(["bit"])), ["coefficient", "abs_importance"], 2)


_one_bit_query("one_bit_logistic", _BALANCED, "logistic", C=1e6)
_one_bit_query("one_bit_tree", _BALANCED, "rf", n_estimators=1, max_depth=1, bootstrap=False)
_one_bit_query("one_bit_boosting", _BOOSTED, "gbt", n_estimators=1, max_depth=1)


# ---------------------------------------------------------------------------------------
# Driver functions
# ---------------------------------------------------------------------------------------

@query("fleet_health", sql(PROC, """
SELECT farm_id, state_name, count(*) AS n_rows, round(avg(target), 6) AS positive_rate, round(avg(rpm_volatility), 4) AS mean_rpm_volatility
FROM lab GROUP BY farm_id, state_name"""))
def fleet_health(spark, sf_dir):
    table = fleet.processed(spark, sf_dir, 6.0)
    return table.groupBy("farm_id", "state_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("target"), 6).alias("positive_rate"),
        F.round(F.avg("rpm_volatility"), 4).alias("mean_rpm_volatility"),
    )


def entry(spark: SparkSession) -> DataFrame:
    """Rows, positive rate and mean rotor volatility per farm and operating state."""
    return fleet_health(spark, SMOKE_DIR)


# Training-data operators live in a subpackage of their own, which may be absent.
try:
    import corpus_pipeline
    from windvane.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "windvane.llm"):
        raise
else:
    _QUERIES.update(llm_queries.QUERIES)
    _ORACLE.update(llm_queries.ORACLE)
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        _ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
