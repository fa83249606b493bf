"""Metrics against direct computation on small score lists."""

import numpy as np
import pytest

from windvane.operators import metrics, quality


def table(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_prob double").repartition(4)


def brute_roc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def brute_ap(y, p):
    total, previous = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - previous) * y[hit].mean()
        previous = recall
    return total


def sample(seed, n=700):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1)
    p[rng.random(n) < 0.33] = 0.5  # a third of the rows share one score
    p[rng.random(n) < 0.3] *= 1e-7  # and many crowd near zero
    return y, p


@pytest.mark.parametrize("seed,rows_per_chunk", [(0, 30), (1, 10**6), (2, 100)])
def test_auc_is_exact(spark, seed, rows_per_chunk):
    y, p = sample(seed)
    row = metrics.auc(table(spark, y, p), rows_per_chunk=rows_per_chunk).first()
    assert row["roc_auc"] == pytest.approx(brute_roc(y, p), abs=1e-12)
    assert row["pr_auc"] == pytest.approx(brute_ap(y, p), abs=1e-12)


def test_auc_ignores_monotone_changes_of_score(spark):
    y, p = sample(4)
    a = metrics.auc(table(spark, y, p)).first()
    b = metrics.auc(table(spark, y, p**3)).first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["pr_auc"] == pytest.approx(b["pr_auc"])


def test_auc_edges(spark):
    assert metrics.auc(table(spark, [1, 1], [0.1, 0.9])).first().asDict() == {"roc_auc": None, "pr_auc": None}
    assert metrics.auc(table(spark, [0, 0], [0.1, 0.9])).first().asDict() == {"roc_auc": None, "pr_auc": None}
    same = metrics.auc(table(spark, [0, 1, 0, 1], [0.5] * 4)).first()
    assert (same["roc_auc"], same["pr_auc"]) == (0.5, 0.5)


def confusion(y, hit):
    return {
        "tn": int(((y == 0) & ~hit).sum()), "fp": int(((y == 0) & hit).sum()),
        "fn": int(((y == 1) & ~hit).sum()), "tp": int(((y == 1) & hit).sum()),
    }


def test_default_grid():
    grid = metrics.default_thresholds()
    assert len(grid) == 55 and grid == sorted(grid) and grid[0] == 0.01 and grid[-1] == 0.99


def test_sweep_matches_direct_counts(spark):
    y, p = sample(5)
    p[:20] = 0.12  # scores equal to a threshold count as reached
    sweep = metrics.threshold_sweep(table(spark, y, p)).toPandas().sort_values("threshold")
    assert len(sweep) == 55 and list(sweep.columns) == [*metrics.SWEEP_COLUMNS, "roc_auc", "pr_auc"]
    for row in sweep.itertuples():
        c = confusion(y, p >= row.threshold)
        assert (row.tn, row.fp, row.fn, row.tp) == tuple(c.values())
        assert row.recall == pytest.approx(c["tp"] / (c["tp"] + c["fn"]))
        assert row.specificity == pytest.approx(c["tn"] / (c["tn"] + c["fp"]))
        assert row.precision == pytest.approx(c["tp"] / max(1, c["tp"] + c["fp"]))
    assert sweep["recall"].is_monotonic_decreasing


def test_custom_grid_is_deduplicated_and_checked(spark):
    df = table(spark, [0, 1], [0.2, 0.8])
    assert [r["threshold"] for r in metrics.threshold_sweep(df, thresholds=[0.5, 0.2, 0.5]).orderBy("threshold").collect()] == [0.2, 0.5]
    for bad in ([], [1.2], [-0.1]):
        with pytest.raises(ValueError):
            metrics.threshold_sweep(df, thresholds=bad)


def test_best_threshold_tie_breaks(spark):
    df = table(spark, [0, 0, 1, 1], [0.1, 0.3, 0.7, 0.9])
    best = metrics.best_threshold(df, thresholds=[0.4, 0.5, 0.6]).first()
    assert (best["threshold"], best["best_score"], best["optimize_for"]) == (0.4, 1.0, "f1")
    # equal precision at two thresholds: the one with more recall wins
    best = metrics.best_threshold(df, optimize_for="precision", thresholds=[0.5, 0.8]).first()
    assert best["threshold"] == 0.5
    with pytest.raises(ValueError, match="accuracy"):
        metrics.best_threshold(df, optimize_for="accuracy")


def test_bundle_values(spark):
    y, p = sample(6)
    row = metrics.evaluate_at_threshold(table(spark, y, p), 0.5).first()
    c = confusion(y, p >= 0.5)
    precision, recall = c["tp"] / (c["tp"] + c["fp"]), c["tp"] / (c["tp"] + c["fn"])
    assert row["f1"] == pytest.approx(2 * precision * recall / (precision + recall))
    assert row["balanced_accuracy"] == pytest.approx((recall + c["tn"] / (c["tn"] + c["fp"])) / 2)
    assert row["accuracy"] == pytest.approx((c["tp"] + c["tn"]) / len(y))
    assert row["prevalence"] == pytest.approx(y.mean())
    assert row["negative_predictive_value"] == pytest.approx(c["tn"] / (c["tn"] + c["fn"]))
    assert row["false_positive_rate"] == pytest.approx(c["fp"] / (c["fp"] + c["tn"]))
    assert (row["support_positive"], row["support_negative"], row["threshold"]) == (y.sum(), (y == 0).sum(), 0.5)
    assert row["roc_auc"] == pytest.approx(brute_roc(y, p))
    with pytest.raises(ValueError, match="threshold"):
        metrics.evaluate_at_threshold(table(spark, y, p), 1.01)


def test_zero_denominators_give_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_true int, y_pred int")
    row = metrics.binary_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["false_negative_rate"]) == (0.0, 0.0, 0.0, 0.0)
    assert (row["balanced_accuracy"], row["accuracy"], row["roc_auc"]) == (1.0, 1.0, None)


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "y_true int, y_pred int")
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert set(rows) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rows["0"]["precision"] == 0.5 and rows["1"]["recall"] == pytest.approx(2 / 3)
    assert rows["macro avg"]["f1_score"] == pytest.approx((0.5 + 2 / 3) / 2)
    assert rows["weighted avg"]["support"] == 5.0 and rows["accuracy"]["precision"] == pytest.approx(0.6)
    single = metrics.classification_report(spark.createDataFrame([(1, 1)], "y_true int, y_pred int")).collect()
    assert {r["class"] for r in single} == {"1", "accuracy", "macro avg", "weighted avg"}


def test_input_checks(spark):
    schema = "y_true int, y_prob double, y_pred int"
    good = spark.createDataFrame([(0, 0.1, 0), (1, 0.2, 1)], schema)
    assert metrics.check_inputs(good, "y_true", "y_prob", "y_pred") == 2
    for row in [(None, 0.1, 0), (2, 0.1, 0), (1, None, 0), (1, float("nan"), 0), (1, 0.1, 3)]:
        with pytest.raises(ValueError):
            metrics.check_inputs(spark.createDataFrame([row], schema), "y_true", "y_prob", "y_pred")
    with pytest.raises(ValueError, match="missing"):
        metrics.check_inputs(good, "label")


@pytest.mark.parametrize("rows_per_chunk", [40, 10**6])
def test_exact_quantiles(spark, rows_per_chunk):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501).round(2), "b": np.repeat([1.0, 2.0], [300, 100]), "c": np.array([4.25])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {(r["k"], r["quantile"]): r["value"] for r in quality.exact_quantiles(df, ["k"], "v", rows_per_chunk=rows_per_chunk).collect()}
    for k, values in groups.items():
        for q in (0.0, 0.25, 0.5, 0.75, 1.0):
            assert got[k, q] == pytest.approx(np.quantile(values, q))
    assert {k for k, _ in got} == set(groups)
    box = {r["k"]: r for r in quality.box_summary(df, "k", "v", rows_per_chunk=rows_per_chunk).collect()}
    assert set(box) == set(groups) and box["a"]["n_values"] == 501


def test_quantiles_read_their_input_once(spark):
    """Few distinct values in many rows, and a value that is costly to compute: box numbers take one pass over the rows."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(200_000).selectExpr("id % 2 AS k", "double(id % 50) AS v").mapInArrow(counted, "k long, v double")
    box = {r["k"]: r for r in quality.box_summary(df, "k", "v", rows_per_chunk=10).collect()}
    assert [box[0][c] for c in ("n_values", "minimum", "median", "maximum")] == [100_000, 0.0, 24.0, 48.0]
    assert read.value == 200_000
