"""Data-quality reports: missingness, distributions, coverage, validation, correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windvane import config
from windvane.operators.ordered_chunks import ROWS_PER_CHUNK, _renamed, _same
from windvane.operators.selection import feature_columns
from windvane.session import materialize, require_columns, small_result, small_side


def _as_rows(one_row: DataFrame, entries: dict[str, dict[str, Column]], label: str) -> DataFrame:
    """Turn one wide aggregate row into one row per entry."""
    structs = [
        F.struct(F.lit(name).alias(label), *[c.alias(alias) for alias, c in columns.items()])
        for name, columns in entries.items()
    ]
    return one_row.select(F.inline(F.array(*structs)))


def _present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL, so that both count as missing."""
    column = F.col(f"`{name}`")
    return F.nanvl(column, F.lit(None)) if isinstance(df.schema[name].dataType, T.FractionalType) and not isinstance(df.schema[name].dataType, T.DecimalType) else column


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fraction of NULL or NaN per column; order by it and limit to get the worst columns."""
    names = list(columns or df.columns)
    counted = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(_present(df, c)).alias(f"_c{i}") for i, c in enumerate(names)]
    )
    fraction = {
        c: {"missing_fraction": F.when(F.col("_n") > 0, (F.col("_n") - F.col(f"_c{i}")).cast("double") / F.col("_n"))}
        for i, c in enumerate(names)
    }
    return _as_rows(counted, fraction, "column")


def distribution(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Value counts including NULL, with the share of all rows."""
    counted = df.groupBy(F.col(column).alias(name or column)).agg(F.count(F.lit(1)).alias("count"))
    total = counted.agg(F.sum("count")).scalar()
    return counted.withColumn("fraction", F.col("count").cast("double") / total)


def farm_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct assets, positive and buffer rows per farm.

    Grouping by turbine first makes the distinct count a plain count of small groups.
    """
    turbines = df.groupBy("farm_id", "asset_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("target", F.lit(0.0))).alias("p"), F.count_if("is_excluded_buffer").alias("b")
    )
    return turbines.groupBy("farm_id").agg(
        F.sum("n").alias("n_rows"), F.count("asset_id").alias("n_assets"),
        F.sum("p").alias("positive_target_rows"), F.sum("b").alias("excluded_buffer_rows"),
    )


def dataset_summary(df: DataFrame, target: str = "target") -> DataFrame:
    """Rows, columns, distinct farms, turbines and events, positive rate.

    One pass: rows collapse to (farm, asset, event) groups before anything is counted.
    """
    groups = df.groupBy("farm_id", "asset_id", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(target).alias("known"), F.sum(F.col(target).cast("double")).alias("hits")
    )
    return groups.agg(
        F.sum("n").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        F.count_distinct("farm_id").alias("unique_farms"), F.count_distinct("asset_id").alias("unique_turbines"),
        F.count_distinct("event_id").alias("unique_events"), F.try_divide(F.sum("hits"), F.sum("known")).alias("positive_rate"),
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    groups = df.groupBy("farm_id", "asset_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_stamp").alias("first"), F.max("time_stamp").alias("last")
    )
    return groups.agg(
        F.sum("n").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.count_distinct("farm_id").alias("n_farms"),
        F.count_distinct("asset_id").alias("n_assets"), F.min("first").alias("min_time"), F.max("last").alias("max_time"),
    )


def split_sizes(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(target).alias("positive_rate"))


def target_counts(df: DataFrame, target: str = "target") -> DataFrame:
    t = F.col(target)
    return df.agg(
        F.count_if(t == 1).alias("positives"), F.count_if(t == 0).alias("negatives"), F.count_if(t.isNull()).alias("missing")
    )


COLUMN_GROUPS = {
    "standard_features": config.STANDARD_FEATURES,
    "named_derived_features": config.DERIVED_FEATURES,
    "temporal_features": config.TEMPORAL_FEATURES,
    "metadata_columns": (*config.IDENTITY_COLUMNS, *config.LABEL_COLUMNS),
}


def feature_coverage(df: DataFrame, groups: dict[str, Sequence[str]] = COLUMN_GROUPS) -> DataFrame:
    """Per expected column: is it there, how many values, how many of them non-zero."""
    have = {f.name: f.dataType for f in df.schema.fields}
    measures, entries = [F.count(F.lit(1)).alias("_n")], {}
    expected = [(group, name) for group, names in groups.items() for name in names]
    for i, (group, name) in enumerate(expected):
        if name in have:
            present = _present(df, name)
            measures.append(F.count(present).alias(f"_c{i}"))
            nonzero = F.count_if(present != 0) if isinstance(have[name], T.NumericType) else F.count(present)
            measures.append(nonzero.alias(f"_z{i}"))
        known = name in have
        entries[name] = {
            "category": F.lit(group), "is_present": F.lit(known),
            "non_null": F.col(f"_c{i}") if known else F.lit(0).cast("bigint"),
            "non_zero": F.col(f"_z{i}") if known else F.lit(0).cast("bigint"),
        }
    return _as_rows(df.agg(*measures), entries, "column")


def schema_validation(df: DataFrame, groups: dict[str, Sequence[str]] = COLUMN_GROUPS) -> DataFrame:
    """Expected, present, missing and value-carrying columns per group."""
    return feature_coverage(df, groups).groupBy("category").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if("is_present").alias("present"),
        F.count_if(~F.col("is_present")).alias("missing"),
        F.count_if(F.col("non_null") > 0).alias("with_values"),
    )


def label_rules() -> dict[str, Column]:
    """What breaks each labelling rule."""
    known = list(config.STATE_CODES.values())
    odd_target = F.col("target").isNotNull() & ~F.col("target").isin(0.0, 1.0)
    return {
        "unknown_state": F.col("state_label").isNotNull() & ~F.col("state_label").isin(known),
        "non_binary_target": ~F.col("is_excluded_buffer") & odd_target,
    }


def label_validation(df: DataFrame) -> DataFrame:
    """Violations per labelling rule; all zero on a sound table."""
    require_columns(df, *config.LABEL_COLUMNS)
    rules = label_rules()
    counted = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return _as_rows(counted, {name: {"violations": F.col(name)} for name in rules}, "rule")


def target_correlation(
    df: DataFrame, columns: Sequence[str] | None = None, target: str = "target", n: int | None = 15
) -> DataFrame:
    """Pearson correlation of numeric columns with the target, highest first.

    Over rows where both values exist; NULL for a constant column, where ``corr`` itself
    would divide by zero and fail.
    """
    names = list(columns or [c for c in feature_columns(df) if c != target])

    def pearson(name: str) -> Column:
        x, y = F.col(name).cast("double"), F.col(target).cast("double")
        spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        return F.try_divide(F.covar_pop(x, y), spread)

    wide = df.agg(*[pearson(c).alias(f"_r{i}") for i, c in enumerate(names)])
    rows = _as_rows(wide, {c: {"correlation": F.col(f"_r{i}")} for i, c in enumerate(names)}, "feature")
    ranked = rows.orderBy(F.desc_nulls_last("correlation"), "feature")
    return ranked if n is None else ranked.limit(n)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, quantiles: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0),
    *, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, without gathering a large group.

    Keys and values are read once, and equal values are counted before they move: later passes grow with the distinct
    values. Only values near a wanted position are sorted.
    """
    keys = list(keys)
    narrow = df.select(*keys, F.col(column).cast("double").alias("_value"))
    return _quantiles(narrow, keys, quantiles, rows_per_chunk)


def _quantiles(narrow: DataFrame, keys: list[str], quantiles: Sequence[float], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``exact_quantiles`` of a written table of keys and ``_value``."""
    rows = narrow.filter("_value IS NOT NULL AND NOT isnan(_value)")
    counts = materialize(rows.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_times")))
    most = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    pieces = max(1, -(-most // rows_per_chunk))
    # Approximate quantiles of the distinct values cut a group into pieces; only pieces that hold a wanted position are sorted.
    cuts = F.array_distinct(F.percentile_approx("_value", [i / pieces for i in range(1, pieces)] or [0.5], max(10_000, 20 * pieces)))
    splitters = small_side(counts.groupBy(*keys).agg(cuts.alias("_seps")).select(*_renamed(keys), "_seps"))
    steps = ", ".join(str(1 << i) for i in range(pieces.bit_length(), -1, -1))
    piece = f"aggregate(array({steps}), 0, (p, s) -> CASE WHEN p + s <= size(_seps) AND _seps[p + s - 1] <= _value THEN p + s ELSE p END)"
    placed = counts.join(splitters, _same(keys)).selectExpr(*[f"`{k}`" for k in keys], "_value", "_times", f"{piece} AS _piece")
    upto = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = materialize(placed.groupBy(*keys, "_piece").agg(F.sum("_times").alias("_rows")).withColumn("_start", F.sum("_rows").over(upto) - F.col("_rows")))
    sizes = totals.groupBy(*keys).agg(F.sum("_rows").alias("_rows"))
    asked = sizes.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    asked = asked.withColumn("_exact", F.col("quantile") * (F.col("_rows") - 1)).drop("_rows")
    at = F.explode(F.array_distinct(F.array(F.floor("_exact"), F.ceil("_exact")))).alias("_position")
    positions = asked.select(*_renamed(keys), at).distinct()
    held = totals.join(positions, _same(keys) & F.expr("_position >= _start AND _position < _start + _rows"))
    held = small_result(held.select(*_renamed(keys), F.col("_piece").alias("_r_piece"), "_position", (F.col("_position") - F.col("_start")).alias("_nth")))
    within = placed.join(held, _same(keys, ("_piece", "_r_piece")), "left_semi")
    inside = Window.partitionBy(*keys, "_piece").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = within.withColumn("_upto", F.sum("_times").over(inside))
    found = ranked.join(held, _same(keys, ("_piece", "_r_piece")) & F.expr("_nth < _upto AND _nth >= _upto - _times")).select(*keys, "_position", "_value")
    listed = found.groupBy(*_renamed(keys)).agg(F.map_from_entries(F.collect_list(F.struct("_position", "_value"))).alias("_at"))
    low, high = (F.col("_at")[place("_exact").cast("long")] for place in (F.floor, F.ceil))
    value = low + (high - low) * (F.col("_exact") - F.floor("_exact"))
    return asked.join(small_side(listed), _same(keys)).select(*keys, "quantile", value.alias("value"))


def box_summary(df: DataFrame, key: str, column: str, **options) -> DataFrame:
    """Box-plot numbers per group: count, minimum, quartiles, maximum."""
    names = {0.0: "minimum", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "maximum"}
    narrow = materialize(df.select(key, F.col(column).cast("double").alias("_value")))
    quantiles = _quantiles(narrow, [key], tuple(names), **options)
    boxes = quantiles.groupBy(key).agg(*[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n) for q, n in names.items()])
    counts = narrow.groupBy(key).agg(F.count("_value").alias("n_values")).filter(F.col("n_values") > 0)
    return counts.join(boxes, key)


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Per class: rows, balanced weight n/(2 n_c), and boosting weight (neg/pos on positives)."""
    counted = df.agg(
        F.count_if(F.col(target) == 0).alias("_neg"), F.count_if(F.col(target) == 1).alias("_pos")
    )
    neg, pos = F.col("_neg").cast("double"), F.col("_pos").cast("double")
    scale = F.when(pos > 0, neg / pos).otherwise(F.lit(1.0))
    entries = [
        F.struct(
            F.lit(label).alias("class"), F.col(count).alias("n_rows"),
            F.when(F.col(count) > 0, (neg + pos) / (2 * F.col(count).cast("double"))).alias("balanced_weight"),
            weight.alias("boosting_weight"),
        )
        for label, count, weight in ((0, "_neg", F.lit(1.0)), (1, "_pos", scale))
    ]
    return counted.select(F.inline(F.array(*entries)))
