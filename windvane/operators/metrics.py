"""Exact binary-classification metrics over (y_true, y_prob) tables of any size.

Counts use one aggregate; a threshold sweep is one histogram pass; the two AUCs use
prefix sums over distinct scores, chunked so that no task sees all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windvane import config
from windvane.functions import rates
from windvane.operators.ordered_chunks import CHUNK, ROWS_PER_CHUNK, OrderedChunks
from windvane.session import require_columns

COUNTS = ("tn", "fp", "fn", "tp")


# -- inputs ------------------------------------------------------------------------------

def input_violations(df: DataFrame, label: str = "y_true", score: str | None = None, predicted: str | None = None) -> DataFrame:
    """One row: how many rows break each input rule of the metrics."""
    checks = {
        "null_labels": F.col(label).isNull(),
        "non_binary_labels": F.col(label).isNotNull() & ~F.col(label).isin(0, 1),
    }
    if score is not None:
        checks["null_scores"] = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    if predicted is not None:
        checks["non_binary_predictions"] = F.col(predicted).isNull() | ~F.col(predicted).isin(0, 1)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(name) for name, c in checks.items()])


def check_inputs(df: DataFrame, label: str = "y_true", score: str | None = None, predicted: str | None = None) -> int:
    """Raise ValueError on NULL or non-binary input; return the row count."""
    require_columns(df, *[c for c in (label, score, predicted) if c])
    row = input_violations(df, label, score, predicted).first().asDict()
    rows = row.pop("n_rows")
    broken = {name: count for name, count in row.items() if count}
    if broken:
        raise ValueError(f"invalid metric input: {broken}")
    return rows


def at_threshold(df: DataFrame, threshold: float, score: str = "y_prob", name: str = "y_pred") -> DataFrame:
    """Hard prediction: 1 where the score reaches the threshold."""
    return df.withColumn(name, (F.col(score) >= F.lit(float(threshold))).cast("int"))


# -- counts and rates --------------------------------------------------------------------

def confusion_counts(df: DataFrame, label: str = "y_true", predicted: str = "y_pred", keys: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion_metrics(df: DataFrame, label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Counts with specificity, NPV, false positive/negative rates and supports."""
    return confusion_counts(df, label, predicted).selectExpr("*", *rates.aliased(rates.CONFUSION))


def binary_metrics(
    df: DataFrame, label: str = "y_true", predicted: str = "y_pred", score: str | None = None,
    *, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Full metric bundle as one row; AUCs are NULL without scores or with one class."""
    bundle = confusion_counts(df, label, predicted).selectExpr(
        "*", *rates.aliased(rates.HEADLINE), *rates.aliased(rates.CONFUSION)
    )
    if score is None:
        return bundle.selectExpr("*", "double(NULL) AS roc_auc", "double(NULL) AS pr_auc")
    return _beside(bundle, auc(df, label, score, rows_per_chunk=rows_per_chunk))


def metrics_by_group(
    df: DataFrame, keys: Sequence[str], label: str = "y_true", predicted: str = "y_pred", score: str | None = None,
    *, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``binary_metrics`` of every group (say, model and part), all from the same passes."""
    keys = list(keys)
    bundle = confusion_counts(df, label, predicted, keys).selectExpr("*", *rates.aliased(rates.HEADLINE), *rates.aliased(rates.CONFUSION))
    if score is None:
        return bundle.selectExpr("*", "double(NULL) AS roc_auc", "double(NULL) AS pr_auc")
    areas = auc_by_group(df, keys, label, score, rows_per_chunk=rows_per_chunk)
    return _joined(bundle, areas, keys)


def _joined(table: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of one row per group beside every row of the group; NULL keys meet."""
    named = groups.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return table.join(named, same, "left").drop(*[f"_r_{k}" for k in keys])


def _beside(table: DataFrame, single: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row, as a scalar subquery."""
    looked_up = table.withColumn("_single", single.select(F.struct("*")).scalar())
    return looked_up.select(*table.columns, "_single.*")


def classification_report(df: DataFrame, label: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' with precision, recall, f1, support.

    As usual for this report, the averages run over the classes that occur in labels or
    predictions, and the accuracy row repeats the accuracy in every rate column.
    """
    zero = (rates.ratio("tn", "tn + fn"), rates.ratio("tn", "tn + fp"), rates.ratio("2 * tn", "2 * tn + fn + fp"))
    one = (rates.HEADLINE["precision"], rates.RECALL, rates.HEADLINE["f1"])
    total = "tn + fp + fn + tp"
    sized = confusion_counts(df, label, predicted).selectExpr(
        *[f"{e} AS {m}0" for m, e in zip("prf", zero)], *[f"{e} AS {m}1" for m, e in zip("prf", one)],
        f"{rates.HEADLINE['accuracy']} AS acc", "double(tn + fp) AS n0", "double(fn + tp) AS n1", f"double({total}) AS n",
        "int(tn + fp + fn > 0) AS seen0", "int(fn + tp + fp > 0) AS seen1",
    )
    macro = [rates.ratio(f"{m}0 * seen0 + {m}1 * seen1", "seen0 + seen1") for m in "prf"]
    weighted = [rates.ratio(f"{m}0 * n0 + {m}1 * n1", "n") for m in "prf"]
    lines = {
        "0": ("p0", "r0", "f0", "n0", "seen0"), "1": ("p1", "r1", "f1", "n1", "seen1"), "accuracy": ("acc", "acc", "acc", "n", "1"),
        "macro avg": (*macro, "n", "1"), "weighted avg": (*weighted, "n", "1"),
    }
    stacked = ", ".join(f"'{name}', {', '.join(values)}" for name, values in lines.items())
    report = sized.selectExpr(f"stack({len(lines)}, {stacked}) AS (class, precision, recall, f1_score, support, seen)")
    return report.filter("seen = 1").drop("seen")


# -- ranking metrics ---------------------------------------------------------------------

def auc(
    df: DataFrame, label: str = "y_true", score: str = "y_prob", *, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Exact ROC AUC (ties count half) and average precision (step sum); NULL for one class."""
    return auc_by_group(df, [], label, score, rows_per_chunk=rows_per_chunk)


def auc_by_group(
    df: DataFrame, keys: Sequence[str], label: str = "y_true", score: str = "y_prob", *, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """``auc`` of every group.

    Rows collapse to distinct scores with map-side combine, so a score shared by a third of
    the rows is one record. Positives and negatives above a chunk of scores come with the
    chunk layout; the running sums restart in every chunk.
    """
    keys = list(keys)
    named = [f"`{k}`" for k in keys]
    rows = df.selectExpr(*named, f"-double(`{score}`) AS _rank", f"double(`{label}`) AS _pos", f"1D - double(`{label}`) AS _neg")
    layout = OrderedChunks.plan(
        rows, keys, ["_rank"], sums=["_pos", "_neg"], rows_per_chunk=rows_per_chunk
    )
    scores = rows.groupBy(*keys, "_rank").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    upto = f"OVER (PARTITION BY {', '.join([*named, CHUNK])} ORDER BY _rank ROWS UNBOUNDED PRECEDING)"
    ranked = layout.assign(scores).selectExpr(
        *named, "_pos", "_neg", f"_before__pos + sum(_pos) {upto} AS _tp", f"_before__neg + sum(_neg) {upto} AS _fp"
    )
    sums = {"p": "sum(_pos)", "n": "sum(_neg)", "roc": "sum((_tp - _pos / 2) * _neg)", "ap": "sum(_pos * _tp / (_tp + _fp))"}
    totals = ranked.groupBy(*keys).agg(*[F.expr(value).alias(name) for name, value in sums.items()])
    return totals.selectExpr(
        *named,
        "CASE WHEN p > 0 AND n > 0 THEN roc / (p * n) END AS roc_auc", "CASE WHEN p > 0 AND n > 0 THEN ap / p END AS pr_auc"
    )


# -- thresholds --------------------------------------------------------------------------

def default_thresholds() -> list[float]:
    """Every even percent from 2 to 98, and the hand-picked thresholds."""
    return sorted({*config.COMMON_THRESHOLDS, *(percent / 100 for percent in range(2, 100, 2))})


def _thresholds_reached(score: str, grid: list[float], low: int = 0, high: int | None = None) -> str:
    """SQL counting the thresholds at or below a score, as a balanced tree of comparisons."""
    high = len(grid) if high is None else high
    if low == high:
        return str(low)
    middle = (low + high) // 2
    above = _thresholds_reached(score, grid, middle + 1, high)
    below = _thresholds_reached(score, grid, low, middle)
    return f"CASE WHEN `{score}` >= {grid[middle]!r}D THEN {above} ELSE {below} END"


# Columns of a sweep.
SWEEP_COLUMNS = (
    "threshold", "precision", "recall", "f1", "balanced_accuracy", "specificity",
    "false_positive_rate", "false_negative_rate", "tp", "fp", "tn", "fn",
    "support_positive", "support_negative",
)


def threshold_sweep(
    df: DataFrame, label: str = "y_true", score: str = "y_prob", thresholds: Iterable[float] | None = None,
    *, with_auc: bool = True, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Metrics at every candidate threshold from one pass over the scores."""
    table = sweep_by_group(df, [], label, score, thresholds, with_auc=False)
    return _beside(table, auc(df, label, score, rows_per_chunk=rows_per_chunk)) if with_auc else table


def sweep_by_group(
    df: DataFrame, keys: Sequence[str], label: str = "y_true", score: str = "y_prob", thresholds: Iterable[float] | None = None,
    *, with_auc: bool = True, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``threshold_sweep`` of every group.

    Each score falls into the bucket of the largest threshold it reaches, so the data is
    reduced to one count pair per bucket before anything is shuffled.
    """
    keys = list(keys)
    grid = default_thresholds() if thresholds is None else sorted({float(t) for t in thresholds})
    if not grid:
        raise ValueError("no candidate thresholds")
    if grid[0] < 0.0 or grid[-1] > 1.0:
        raise ValueError("thresholds must lie in [0, 1]")
    steps = F.array(*[F.lit(t) for t in grid])
    reached = F.expr(_thresholds_reached(score, grid))
    histogram = df.groupBy(*keys, reached.alias("bucket")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # At most len(grid) + 1 rows of a group from here on; empty buckets are filled in.
    named = [f"`{k}`" for k in keys]
    listed = histogram.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("pos", "neg")))).alias("_of"))
    filled = listed.selectExpr(*named, "_of", f"explode(sequence(0, {len(grid)})) AS bucket").selectExpr(
        *named, "bucket", "coalesce(_of[bucket].pos, 0L) AS pos", "coalesce(_of[bucket].neg, 0L) AS neg"
    )
    group = f"PARTITION BY {', '.join(named) or '0'}"
    upward = f"OVER ({group} ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)"
    counted = filled.selectExpr(
        *named, "bucket", f"sum(pos) {upward} AS tp", f"sum(neg) {upward} AS fp",
        f"sum(pos) OVER ({group}) AS p", f"sum(neg) OVER ({group}) AS n",
    ).filter("bucket > 0")
    table = counted.select(
        *keys, F.element_at(steps, F.col("bucket")).alias("threshold"), "tp", "fp",
        (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"),
    ).selectExpr(*named, "threshold", *COUNTS, *rates.aliased(rates.HEADLINE), *rates.aliased(rates.CONFUSION)).select(*keys, *SWEEP_COLUMNS)
    return _joined(table, auc_by_group(df, keys, label, score, rows_per_chunk=rows_per_chunk), keys) if with_auc else table


def best_of_sweep(sweep: DataFrame, optimize_for: str = "f1") -> DataFrame:
    """The sweep row with the best score; ties by recall, precision, then lower threshold."""
    if optimize_for not in config.TUNABLE_METRICS:
        raise ValueError(f"unsupported optimize_for={optimize_for!r}; known: {sorted(config.TUNABLE_METRICS)}")
    ranked = sweep.orderBy(F.desc(optimize_for), F.desc("recall"), F.desc("precision"), F.asc("threshold"))
    return ranked.limit(1).withColumns({"optimize_for": F.lit(optimize_for), "best_score": F.col(optimize_for)})


def best_by_group(sweep: DataFrame, keys: Sequence[str], optimize_for: str = "f1") -> DataFrame:
    """``best_of_sweep`` of every group of a keyed sweep."""
    if optimize_for not in config.TUNABLE_METRICS:
        raise ValueError(f"unsupported optimize_for={optimize_for!r}; known: {sorted(config.TUNABLE_METRICS)}")
    order = [F.desc(optimize_for), F.desc("recall"), F.desc("precision"), F.asc("threshold")]
    ranked = sweep.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_place = 1").drop("_place").withColumns({"optimize_for": F.lit(optimize_for), "best_score": F.col(optimize_for)})


def best_threshold(
    df: DataFrame, label: str = "y_true", score: str = "y_prob", optimize_for: str = "f1",
    thresholds: Iterable[float] | None = None, *, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Winning threshold with its metrics."""
    if optimize_for not in config.TUNABLE_METRICS:
        raise ValueError(f"unsupported optimize_for={optimize_for!r}; known: {sorted(config.TUNABLE_METRICS)}")
    return best_of_sweep(threshold_sweep(df, label, score, thresholds, rows_per_chunk=rows_per_chunk), optimize_for)


def top_thresholds(sweep: DataFrame, n: int = 15) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), F.asc("threshold")).limit(n)


def best_f1_threshold(sweep: DataFrame) -> DataFrame:
    """Lowest threshold with the highest F1 (the point marked on a threshold curve)."""
    require_columns(sweep, "threshold", "precision", "recall", "f1")
    return sweep.orderBy(F.desc("f1"), F.asc("threshold")).limit(1).select("threshold", "f1")


def evaluate_at_threshold(
    df: DataFrame, threshold: float = 0.5, label: str = "y_true", score: str = "y_prob",
    *, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Full metric bundle of the scores cut at ``threshold``."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold must be in [0, 1], got {threshold}")
    bundle = binary_metrics(at_threshold(df, threshold, score), label, "y_pred", score, rows_per_chunk=rows_per_chunk)
    return bundle.withColumn("threshold", F.lit(float(threshold)))
