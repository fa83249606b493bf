"""Event index and per-event timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windvane import config
from windvane.functions import sensors, states
from windvane.operators.ordered_chunks import BEFORE, ROWS_PER_CHUNK, OrderedChunks
from windvane.session import materialize, require_columns, small_result, small_side

INDEX_COLUMNS = ("farm_id", "asset_id", "event_id", "event_label", "event_start", "event_end")


def event_index(df: DataFrame, source_col: str | None = None) -> DataFrame:
    """Distinct turbine/event combinations with a known start, and their output name."""
    require_columns(df, *INDEX_COLUMNS)
    extra = [source_col] if source_col else []
    parts = [
        F.lit("farm_"), F.col("farm_id"), F.lit("_turbine_"), F.col("asset_id"), F.lit("_event_"),
        F.col("event_id").cast("string"), F.lit("_"), F.coalesce(states.safe_label(F.col("event_label")), F.lit("None")), F.lit(".png"),
    ]
    if source_col:
        parts = [states.file_stem(F.col(source_col)), F.lit("__"), *parts]
    distinct = df.select(*extra, *INDEX_COLUMNS).na.drop(subset=["event_start"]).distinct()
    return distinct.withColumn("file_name", F.concat(*parts))


def sorted_event_index(df: DataFrame, source_col: str | None = None) -> DataFrame:
    return event_index(df, source_col).orderBy("farm_id", "asset_id", "event_start", "event_id")


def _window_join(df: DataFrame, events: DataFrame, time: Column, before: float, after: float) -> DataFrame:
    """Telemetry rows inside each event's window, by (farm, asset) and time.

    An event listed more than once counts once. Events are spread over the days their window touches and joined on (farm, asset, day),
    so a row meets only events near it, and a hot turbine is divided. The span of all
    windows is a literal filter that reaches the telemetry scan.
    """
    low = F.col("_e_start") - states.hours(before)
    high = F.col("_e_start") + states.hours(after)
    named = events.select(
        F.col("farm_id").alias("_e_farm"), F.col("asset_id").alias("_e_asset"), F.col("event_id").alias("_e_event"),
        F.col("event_label").alias("_e_label"), F.col("event_start").alias("_e_start"), F.col("event_end").alias("_e_end"),
    ).filter(F.col("_e_start").isNotNull()).distinct()
    same = (F.col("farm_id") == F.col("_e_farm")) & (F.col("asset_id") == F.col("_e_asset"))
    inside = (time >= low) & (time <= high)
    named = materialize(named)
    size, earliest, latest = named.agg(
        F.count(F.lit(1)), F.min(low).cast("string"), F.max(high).cast("string")
    ).first()
    if size:
        df = df.filter(time.between(F.lit(earliest).cast("timestamp_ntz"), F.lit(latest).cast("timestamp_ntz")))
    days = F.sequence(F.to_date(low), F.to_date(high), F.expr("interval 1 day"))
    spread = named.withColumn("_e_day", F.explode(days))
    return df.withColumn("_day", F.to_date(time)).join(small_side(spread), same & (F.col("_day") == F.col("_e_day")) & inside).drop("_day", "_e_day")


def event_timeline(
    df: DataFrame,
    events: DataFrame | None = None,
    signals: Sequence[str] = config.TIMELINE_SIGNALS,
    *,
    hours_before: float = 168,
    hours_after: float = 24,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows around every event start with relative hours and z-scored signals.

    Without ``events`` each row is placed around the event it already carries, as in the
    processed table; with ``events`` any telemetry is matched by turbine and time.
    z-scores use the mean and sample deviation inside the event's window; a missing or zero
    deviation gives 0. The statistics are an aggregate joined back, so a long event is
    never gathered in one task.
    """
    require_columns(df, "time_stamp", "farm_id", "asset_id", *signals)
    time = F.col("time_stamp")
    if events is None:
        require_columns(df, *INDEX_COLUMNS)
        start = F.col("event_start")
        window = df.filter(time.between(start - states.hours(hours_before), start + states.hours(hours_after)))
        window = window.select("time_stamp", *INDEX_COLUMNS, *signals, *keep)
    else:
        slim = df.select("time_stamp", "farm_id", "asset_id", *signals, *keep)
        joined = _window_join(slim, events, time, hours_before, hours_after)
        window = joined.select(
            "time_stamp", "farm_id", "asset_id", F.col("_e_event").alias("event_id"), F.col("_e_label").alias("event_label"),
            F.col("_e_start").alias("event_start"), F.col("_e_end").alias("event_end"), *signals, *keep,
        )
    clean = window.withColumns({s: sensors.null_if_nan(F.col(s).cast("double")) for s in signals})
    by = ["farm_id", "asset_id", "event_id", "event_start"]
    stats = clean.groupBy(*[F.col(k).alias(f"_k_{k}") for k in by]).agg(
        *[F.avg(s).alias(f"_mean_{s}") for s in signals], *[F.stddev_samp(s).alias(f"_std_{s}") for s in signals]
    )
    match = F.lit(True)
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    scored = clean.join(small_result(stats), match)

    def z(signal: str) -> Column:
        deviation = F.col(f"_std_{signal}")
        scaled = F.when(deviation != 0, (F.col(signal) - F.col(f"_mean_{signal}")) / deviation)
        return F.when(deviation.isNull() | (deviation == 0), F.lit(0.0)).otherwise(scaled)

    return scored.select(
        *window.columns,
        states.hours_between(F.col("event_start"), time).alias("hours_from_event_start"),
        *[z(s).alias(f"{s}_z") for s in signals],
    )


def prediction_timeline(
    predictions: DataFrame, events: DataFrame | None = None, score: str = "y_proba", *,
    threshold: float = 0.78, hours_before: float = 168, hours_after: float = 24,
) -> DataFrame:
    """Predicted probability around every event, with the decision at ``threshold``."""
    missing = sorted({"time_stamp", "farm_id", "asset_id", score} - set(predictions.columns))
    if missing:
        raise KeyError(f"missing required columns: {missing}")
    lines = event_timeline(predictions, events, [score], hours_before=hours_before, hours_after=hours_after)
    return lines.withColumn("y_pred", (F.col(score) >= threshold).cast("int"))


def failure_bands(
    df: DataFrame, *, asset_id: str | None = None, order: Sequence[str] = ("time_stamp", "row_id"),
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Start, end and length of every run of consecutive target=1 rows of an asset.

    A run is a stretch where the row number minus the number of positive rows so far stays
    constant. Both come from one window per chunk plus what the chunk layout counted before.
    """
    require_columns(df, "farm_id", "asset_id", "target", *order)
    keys = ["farm_id", "asset_id"]
    chosen = df if asset_id is None else df.filter(F.col("asset_id") == asset_id)
    narrow = chosen.select(*keys, *order, F.coalesce((F.col("target") == 1).cast("int"), F.lit(0)).alias("_hit"))
    layout = OrderedChunks.plan(narrow, keys, list(order), sums=["_hit"], rows_per_chunk=rows_per_chunk)
    window = layout.window()
    row = F.col(BEFORE) + F.row_number().over(window)
    hits = F.col("_before__hit") + F.sum("_hit").over(window.rowsBetween(Window.unboundedPreceding, 0))
    numbered = layout.assign(narrow).withColumn("_run", row - hits.cast("bigint"))
    return numbered.filter("_hit = 1").groupBy(*keys, "_run").agg(
        F.min(order[0]).alias("band_start"), F.max(order[0]).alias("band_end"), F.count(F.lit(1)).alias("n_rows")
    ).drop("_run")
