"""Event lookup and state labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane import config
from windvane.functions import states
from windvane.session import require_columns, small_result

EVENT_COLUMNS = ["event_label", "event_start", "event_end"]


def first_event_per_id(events: DataFrame, order: str | None = None) -> DataFrame:
    """One metadata row per (farm, event): the first in ``order`` (map-side combined)."""
    details = F.struct(*EVENT_COLUMNS)
    first_by = F.col(order) if order else F.struct(F.coalesce("event_start", F.lit("9999-01-01").cast("timestamp_ntz")), "event_label")
    chosen = events.groupBy("farm_id", "event_id").agg(F.min_by(details, first_by).alias("_e"))
    return chosen.select("farm_id", "event_id", "_e.*")


def attach_events(df: DataFrame, events: DataFrame, order: str | None = None) -> DataFrame:
    """Left lookup of event metadata by (farm, event); unknown events keep NULL metadata."""
    require_columns(df, "farm_id", "event_id")
    lookup = first_event_per_id(events, order)
    return df.join(small_result(lookup), ["farm_id", "event_id"], "left")


def label_states(
    df: DataFrame,
    events: DataFrame,
    *,
    buffer_before_hours: float = 0.0,
    buffer_after_hours: float = 0.0,
    order: str | None = None,
) -> DataFrame:
    """Add event metadata, state code and name, buffer flag and default target to every row."""
    require_columns(df, "time_stamp")
    code = states.state_code(buffer_before_hours=buffer_before_hours, buffer_after_hours=buffer_after_hours)
    labelled = attach_events(df, events, order).withColumn("state_label", code)
    return labelled.withColumns({
        "state_name": states.state_name(F.col("state_label")),
        "is_excluded_buffer": F.col("state_label") == config.STATE_CODES[config.BUFFER_STATE],
        "target": states.default_target(F.col("state_label")),
    })


def binary_target(
    df: DataFrame,
    positive_states: Sequence[str | int],
    *,
    state_col: str = "state_label",
    target_col: str = "target",
    buffer_state: str | int = config.BUFFER_STATE,
    check: bool = True,
) -> DataFrame:
    """Experiment target from state codes; unknown states (asked for or observed) are errors."""
    require_columns(df, state_col)
    target = states.experiment_target(F.col(state_col), positive_states, buffer_state)
    if check:
        odd = (
            df.select(state_col)
            .filter(F.col(state_col).isNotNull() & ~F.col(state_col).isin(list(config.STATE_CODES.values())))
            .limit(1)
            .collect()
        )
        if odd:
            raise ValueError(f"state outside the known codes: {odd[0][0]}")
    return df.withColumn(target_col, target)


def membership_target(df: DataFrame, positive_states: Sequence[str], target_col: str = "target") -> DataFrame:
    """Target by state name membership: buffer rows count as 0 and are kept."""
    column = next((c for c in ("state_name", "canonical_state", "canonical_state_name") if c in df.columns), None)
    if column is None:
        raise KeyError("no state name column found")
    hit = F.coalesce(F.col(column).isin(list(positive_states)), F.lit(False))
    return df.withColumn(target_col, hit.cast("int"))


def experiment_dataset(df: DataFrame, experiment: config.Experiment, check: bool = True) -> DataFrame:
    """Rows and target of one experiment: buffer rows dropped, or kept as 0 when asked."""
    if experiment.buffer_as_negative:
        return membership_target(df, experiment.positive_states)
    labelled = binary_target(df, experiment.positive_states, check=check)
    return labelled.filter(F.col("target").isNotNull())
