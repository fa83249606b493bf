"""Derived and temporal features of each event history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windvane import config
from windvane.functions import sensors
from windvane.operators.ordered_chunks import CHUNK, OrderedChunks, with_halo

HISTORY = ["farm_id", "event_id"]
FILE = "source_file"
ORDER = ["time_stamp", "row_id"]
WINDOW_ROWS = 100_000  # rows of a chunk: a task sorts them twice, with all window columns


def history_keys(df: DataFrame) -> list[str]:
    """A history is one event of a farm, and one file where the table names its files."""
    return [*HISTORY, FILE] if FILE in df.columns else HISTORY


def physics_features(df: DataFrame) -> DataFrame:
    """Row-local features; those whose inputs are absent are not added."""
    have = set(df.columns)
    added: dict[str, Column] = {}
    if {"gearbox_oil_temp", "amb_temp"} <= have:
        added["temp_delta_gearbox"] = F.coalesce(F.col("gearbox_oil_temp") - F.col("amb_temp"), sensors.zero())
    if {"nacelle_temp", "hub_temp"} <= have:
        added["temp_divergence"] = F.col("nacelle_temp") - F.col("hub_temp")
    if {"wind_speed", "active_power"} <= have:
        added["power_efficiency"] = sensors.power_efficiency(F.col("active_power"), F.col("wind_speed"))
    if "vibration_raw" in have:
        added["vibration_magnitude"] = F.abs("vibration_raw")
    return df.withColumns(added)


def _lag_delta(name: str, rows: int, history: str) -> str:
    return f"`{name}` - lag(`{name}`, {rows}) OVER ({history})"


def _lag_columns(have: set[str], history: str) -> dict[str, str]:
    columns = {}
    if "gearbox_oil_temp" in have:
        columns["temp_trend_24h"] = _lag_delta("gearbox_oil_temp", config.TREND_ROWS, history)
    for signal in config.LAG_SIGNALS:
        if signal in have:
            columns |= {f"{signal}_delta_{rows}": _lag_delta(signal, rows, history) for rows in config.LAG_WINDOWS}
    return columns


def _deviation_columns(have: set[str]) -> dict[str, tuple[str, int]]:
    """Name, signal and rows of every rolling deviation."""
    columns = {"rpm_volatility": ("gen_speed", config.RPM_ROWS)}
    columns |= {f"{signal}_volatility_{rows}": (signal, rows) for signal in config.LAG_SIGNALS for rows in config.LAG_WINDOWS}
    return {name: (signal, rows) for name, (signal, rows) in columns.items() if signal in have}


def _merged_deviation(x: str, rows: int) -> str:
    """SQL of a sample deviation over the last ``rows`` rows, from sums inside this block of rows and the one before."""
    a, b = f"_a_{x}", f"_b_{x}"
    ago_a, ago_b = f"_ago_a{rows}_{x}", f"_ago_b{rows}_{x}"
    start = f"_row - {rows}"  # the last row before the window
    total = lambda own, ago, full: f"CASE WHEN _own = {rows} THEN {own} WHEN _own > {rows} THEN {own} - {ago} ELSE {own} + {full} - {ago} END"
    squares = f"({total(b, ago_b, f'_full_b_{x}')}) - pow({total(a, ago_a, f'_full_a_{x}')}, 2) / {rows}"
    return (
        f"CASE WHEN {start} < coalesce(_gap_{x}, 0) THEN NULL WHEN _odd_{x} > {start} THEN double('nan')"
        f" WHEN _since_{x} <= {start} + 1 THEN 0D ELSE sqrt(greatest(0D, {squares}) / {rows - 1}) END"
    )


def rolling_deviations(df: DataFrame, columns: dict[str, tuple[str, int]], keys: list[str], order: list[str]) -> DataFrame:
    """Add sample deviations of the last rows of a signal, NULL unless all of them are present.

    Every row costs the same, however long the window: running sums of values and squares are subtracted over a lag.
    The sums start anew in every block of as many rows as the longest window, so that a window meets two blocks at
    most, and are taken relative to the first value of the history, so that neither a large offset nor a long history
    costs digits: what is lost is about 1e-7 of the signal's range. A constant window is exactly 0; one with NaN or an
    infinite value is NaN.
    """
    columns = {name: (signal, rows) for name, (signal, rows) in columns.items() if rows > 1}
    if not columns:
        return df
    signals = list(dict.fromkeys(signal for signal, _ in columns.values()))
    block = max(rows for _, rows in columns.values())
    by, sort = ", ".join(f"`{k}`" for k in keys), ", ".join(f"`{name}` ASC NULLS LAST" for name in order)
    # The later windows ask for one and the same order, so only one more sort is needed.
    first, inner, history = f"PARTITION BY {by} ORDER BY {sort}", f"PARTITION BY {by}, _block ORDER BY _row", f"PARTITION BY {by} ORDER BY _block, _row"
    upto, earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    finite, opened, placed, summed, joined = ([] for _ in range(5))
    opened += [f"row_number() OVER ({first}) AS _row"]
    placed += [f"(_row - 1) div {block} AS _block", f"int((_row - 1) % {block}) + 1 AS _own"]
    for x in signals:
        odd = f"isnan(double(`{x}`)) OR abs(double(`{x}`)) = double('infinity')"
        finite += [f"CASE WHEN NOT ({odd}) THEN double(`{x}`) END AS _x_{x}"]
        opened += [f"first(_x_{x}, true) OVER ({first} {upto}) AS _c_{x}", f"lag(_x_{x}) OVER ({first}) AS _was_{x}"]
        placed += [f"coalesce(_x_{x} - _c_{x}, 0D) AS _d_{x}", f"_x_{x} <=> _was_{x} AS _same_{x}"]
        summed += [f"sum(_d_{x}) OVER ({inner} {upto}) AS _a_{x}", f"sum(_d_{x} * _d_{x}) OVER ({inner} {upto}) AS _b_{x}"]
        joined += [f"last(CASE WHEN _own = {block} THEN _{m}_{x} END, true) OVER ({history} {earlier}) AS _full_{m}_{x}" for m in "ab"]
        for name, when in (("gap", f"`{x}` IS NULL"), ("odd", f"{odd}"), ("since", f"NOT _same_{x}")):
            joined += [f"last(CASE WHEN {when} THEN _row END, true) OVER ({history} {upto}) AS _{name}_{x}"]
        for rows in sorted({rows for signal, rows in columns.values() if signal == x}):
            joined += [f"lag(_{m}_{x}, {rows}) OVER ({history}) AS _ago_{m}{rows}_{x}" for m in "ab"]
    kept = [f"`{c}`" for c in df.columns] + ["_row", "_block", "_own"]
    out = df.selectExpr("*", *finite).selectExpr("*", *opened).selectExpr("*", *placed).drop(*[f"_{n}_{x}" for x in signals for n in ("x", "c", "was")])
    out = out.selectExpr(*kept, *[f"_{n}_{x}" for x in signals for n in ("same",)], *summed)
    out = out.selectExpr(*kept, *[f"_{m}_{x}" for x in signals for m in "ab"], *joined)
    return out.selectExpr(*[f"`{c}`" for c in df.columns], *[f"{_merged_deviation(x, rows)} AS `{name}`" for name, (x, rows) in columns.items()])


def temporal_features(
    df: DataFrame,
    *,
    wanted: set[str] | None = None,
    keys: list[str] | None = None,
    order: list[str] = ORDER,
    rows_per_chunk: int = WINDOW_ROWS,
) -> DataFrame:
    """Lags, trends and rolling deviations over each history (file, if named), in one shuffle.

    All columns share one window ordering. Histories above ``rows_per_chunk`` are cut into
    chunks that carry the 144 rows before them, so a huge turbine is spread over many tasks
    with results identical to the uncut window.
    """
    keys = history_keys(df) if keys is None else keys
    layout = OrderedChunks.plan(df, keys, order, halo=config.TREND_ROWS, rows_per_chunk=rows_per_chunk)
    place = [*keys] if layout.trivial else [*keys, CHUNK]
    history = (
        f"PARTITION BY {', '.join(f'`{k}`' for k in place)}"
        f" ORDER BY {', '.join(f'`{name}` ASC NULLS LAST' for name in order)}"
    )
    have = set(df.columns)
    chosen = lambda columns: {name: x for name, x in columns.items() if wanted is None or name in wanted}
    lags = {name: F.expr(sql) for name, sql in chosen(_lag_columns(have, history)).items()}
    cut = df if layout.trivial else with_halo(layout, df)
    # A fixed number of partitions keeps few chunks in a task: joined by their shuffled bytes, they would be as many as fit
    # before the window columns widen the rows. Up to 200 are written without sorting, in next to no memory.
    full = layout.total // max(rows_per_chunk, WINDOW_ROWS)
    parts = max(df.sparkSession.sparkContext.defaultParallelism, min(200, 4 * full), full // 2)
    cut = cut.repartition(parts, *place) if place else cut
    out = rolling_deviations(cut.withColumns(lags), chosen(_deviation_columns(have)), place, order)
    return out if layout.trivial else out.filter("NOT _is_halo").drop(CHUNK, "_is_halo")


def fill_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL and NaN become 0."""
    filled = set(columns)
    return df.selectExpr(*[f"nanvl(coalesce(`{c}`, 0D), 0D) AS `{c}`" if c in filled else f"`{c}`" for c in df.columns])


def derive_features(df: DataFrame, *, rows_per_chunk: int = WINDOW_ROWS, fill: bool = True) -> DataFrame:
    """Physics and temporal features, then every remaining missing value becomes 0."""
    derived = temporal_features(physics_features(df), rows_per_chunk=rows_per_chunk)
    if not fill:
        return derived
    names = [*config.STANDARD_FEATURES, *config.DERIVED_FEATURES, *config.TEMPORAL_FEATURES]
    return fill_missing(derived, [c for c in names if c in derived.columns])
