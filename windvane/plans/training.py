"""Fault classifiers (logistic regression, histogram trees), with threshold tuning and evaluation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane import config
from windvane.operators import metrics, quality
from windvane.plans.linear import LinearModel
from windvane.plans.trees import TreeModel
from windvane.session import ensure_checkpoint_dir, materialize, require_columns

MODEL_TYPES = config.EXPERIMENT_MODELS
COMPACT = ("precision", "recall", "f1", "roc_auc", "pr_auc", "balanced_accuracy", "specificity", "threshold")


def target_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: negatives, positives, NULL targets and all rows."""
    require_columns(df, label)
    y = F.col(label)
    return df.agg(
        F.count_if(y == 0).alias("neg"), F.count_if(y == 1).alias("pos"),
        F.count_if(y.isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"),
    )


def _label_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """Negatives and positives; NULL or non-binary labels are an error."""
    row = target_counts(df, label).first()
    if row["nulls"]:
        raise ValueError(f"{row['nulls']} NULL targets; drop them before fitting")
    if row["neg"] + row["pos"] != row["n"]:
        raise ValueError("targets must be 0 or 1")
    return row["neg"], row["pos"]


def _weights(model_type: str, train: DataFrame) -> tuple[float, float]:
    """Weights of classes 0 and 1: boosting or balanced weights of ``quality.class_weights``."""
    kind = "boosting_weight" if model_type == "gbt" else "balanced_weight"
    weights = {r["class"]: r[kind] for r in quality.class_weights(train, "label").collect()}  # two rows
    return weights[0] or 1.0, weights[1] or 1.0


@dataclass
class FaultModel:
    """A classifier over ``features``/``label`` tables with a tunable decision threshold."""

    model_type: str = "gbt"
    params: dict = field(default_factory=dict)
    seed: int = 42
    threshold: float = 0.5
    tuning: dict | None = None
    sweep: DataFrame | None = None
    fitted: LinearModel | TreeModel | None = None
    rows: int = 0

    def __post_init__(self) -> None:
        self.model_type = config.model_name(self.model_type)
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"unsupported model type {self.model_type!r}; known: {sorted(MODEL_TYPES)}")
        self.params = {**config.MODEL_DEFAULTS[self.model_type], **self.params}

    def fit(self, train: DataFrame) -> "FaultModel":
        neg, pos = _label_counts(train, "label")
        self.rows = neg + pos
        ensure_checkpoint_dir(train.sparkSession)
        weights = _weights(self.model_type, train)
        if self.model_type == "logistic":
            self.fitted = LinearModel.fit(train, self.params["C"], weights, self.params["max_iter"])
        else:
            self.fitted = TreeModel.fit(train, self.model_type, self.params, weights, self.seed)
        return self

    def _require_fit(self) -> LinearModel | TreeModel:
        if self.fitted is None:
            raise ValueError("fit the model first")
        return self.fitted

    def score(self, df: DataFrame, name: str = "y_prob") -> DataFrame:
        """Add the probability of class 1."""
        return self._require_fit().score(df, name)

    def predict(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        return metrics.at_threshold(self.score(df), self.threshold if threshold is None else threshold)

    def tune(self, val: DataFrame, optimize_for: str = "f1", thresholds: Iterable[float] | None = None) -> float:
        """Choose the decision threshold on validation rows."""
        if optimize_for not in config.TUNABLE_METRICS:
            raise ValueError(f"unsupported optimize_for={optimize_for!r}")
        scores = self._scores(val)
        metrics.check_inputs(scores, "label", "y_prob")
        sweep = metrics.threshold_sweep(scores, "label", "y_prob", thresholds)
        return self.tuned(metrics.best_of_sweep(sweep, optimize_for).first().asDict(), sweep)

    def tuned(self, tuning: dict, sweep: DataFrame) -> float:
        """Take the threshold of a sweep's best row."""
        self.tuning, self.sweep, self.threshold = tuning, sweep, float(tuning["threshold"])
        return self.threshold

    def fit_and_tune(self, train: DataFrame, val: DataFrame, optimize_for: str = "f1", thresholds=None) -> float:
        return self.fit(train).tune(val, optimize_for, thresholds)

    def refit(self, train_and_val: DataFrame) -> "FaultModel":
        """Fit again on more rows, keeping the tuned threshold."""
        return self.fit(train_and_val)

    def _scores(self, df: DataFrame) -> DataFrame:
        """Label and probability, written once: the metrics read them several times."""
        return materialize(self.score(df).select("label", "y_prob"))

    def evaluate_detailed(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        cut = self.threshold if threshold is None else threshold
        return metrics.evaluate_at_threshold(self._scores(df), float(cut), "label", "y_prob")

    def evaluate(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        return self.evaluate_detailed(df, threshold).select(*COMPACT)

    def importance(self, names: Sequence[str], sort: bool = True) -> DataFrame:
        """Coefficient and its size for the linear model, split gain share for trees."""
        model = self._require_fit()
        spark = SparkSession.active()
        if self.model_type == "logistic":
            values = [float(v) for v in model.coefficients]
            rows = [(n, v, abs(v)) for n, v in zip(names, values, strict=True)]
            table, by = spark.createDataFrame(rows, "feature string, coefficient double, abs_importance double"), "abs_importance"
        else:
            values = [float(v) for v in model.importances]
            table, by = spark.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double"), "importance"
        return table.orderBy(F.desc(by), "feature") if sort else table


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    by = "importance" if "importance" in importance.columns else "abs_importance"
    return importance.orderBy(F.desc(by), "feature").limit(n)
