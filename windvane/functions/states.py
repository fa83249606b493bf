"""Column expressions for event states and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from windvane import config


def hours(value: float) -> Column:
    """Day-time interval of a fractional number of hours."""
    return F.expr(_hours_sql(value))


def event_id_from_stem(stem: Column) -> Column:
    """All digits of a file stem, read as one number; NULL when there are none."""
    return F.regexp_replace(stem, "[^0-9]", "").try_cast("bigint")


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def _hours_sql(value: float) -> str:
    return f"make_dt_interval(0, 0, 0, cast({value * 3600:.6f} AS decimal(18,6)))"


def state_code(
    time: str = "time_stamp",
    label: str = "event_label",
    start: str = "event_start",
    end: str = "event_end",
    buffer_before_hours: float = 0.0,
    buffer_after_hours: float = 0.0,
) -> Column:
    """State code of a row relative to its event, from the named columns.

    Only anomalies create states. The event itself wins over the look-back bands, those
    win over the exclusion buffers; unmatched rows (and missing bounds) stay normal.
    """
    def band(upper: float, lower: float) -> str:
        return f"{time} >= {start} - {_hours_sql(upper)} AND {time} < {start} - {_hours_sql(lower)}"

    codes = config.STATE_CODES
    cases = [
        (f"{time} >= {start} AND {time} <= {end}", "event_occurring"),
        (band(24, 0), "pre_0_24h"), (band(48, 24), "pre_24_48h"), (band(72, 48), "pre_48_72h"),
    ]
    if buffer_before_hours > 0:
        cases.append((band(72 + buffer_before_hours, 72), config.BUFFER_STATE))
    if buffer_after_hours > 0:
        cases.append((f"{time} > {end} AND {time} <= {end} + {_hours_sql(buffer_after_hours)}", config.BUFFER_STATE))
    bands = " ".join(f"WHEN {condition} THEN {codes[name]}" for condition, name in cases)
    normal = codes["normal"]
    return F.expr(f"CASE WHEN lower({label}) = 'anomaly' THEN CASE {bands} ELSE {normal} END ELSE {normal} END")


def state_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in config.STATE_NAMES]), code + 1)


def default_target(code: Column) -> Column:
    """1 for every pre-event or event state, 0 for normal, NULL for buffer rows."""
    return F.when(code.between(1, 4), F.lit(1.0)).when(code == 0, F.lit(0.0))


def experiment_target(code: Column, positive: Sequence[str | int], buffer: str | int = config.BUFFER_STATE) -> Column:
    """1 for positive states, 0 for the others, NULL for buffer or missing states."""
    positive_codes = sorted({config.state_code(s) for s in positive})
    positive_hit = code.isin(positive_codes) if positive_codes else F.lit(False)
    return F.when(code.isNull() | (code == config.state_code(buffer)), F.lit(None).cast("double")).when(
        positive_hit, F.lit(1.0)
    ).otherwise(F.lit(0.0))


def turbine_key(farm: Column, asset: Column) -> Column:
    return F.concat_ws("__", farm.cast("string"), asset.cast("string"))


def safe_label(label: Column) -> Column:
    """Label usable in a file name: blanks and slashes become underscores."""
    return F.translate(label, " /", "__")


def hours_between(start: Column, time: Column) -> Column:
    """Signed fractional hours from ``start`` to ``time``."""
    return F.timestamp_diff("MICROSECOND", start, time) / F.lit(3.6e9)
