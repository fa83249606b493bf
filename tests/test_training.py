"""Models, tuning and experiment runs on a small separable fleet."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windvane import config
from windvane.operators import metrics, selection, splits
from windvane.plans import experiments, training
from windvane.sources import writers

SHORT = {"logistic": {"max_iter": 30}, "rf": {"n_estimators": 5, "max_depth": 4}, "gbt": {"n_estimators": 3, "max_depth": 3}}


@pytest.fixture(scope="module")
def processed(spark):
    """Twenty events; rows near the fault run hotter."""
    rows = spark.range(3000).withColumns({"event_id": F.col("id") % 20, "u": (F.col("id") * 7919 % 1000) / 1000.0})
    code = F.when(F.col("id") % 9 == 0, 3).when(F.col("id") % 31 == 0, 5).when(F.col("id") % 23 == 0, 4).otherwise(0)
    return rows.select(
        F.col("id").alias("row_id"), F.lit("A").alias("farm_id"), F.col("event_id").cast("string").alias("asset_id"), "event_id",
        F.timestamp_micros(F.col("id") * 600_000_000 + F.col("event_id") * 86_400_000_000).cast("timestamp_ntz").alias("time_stamp"),
        code.alias("state_label"), F.element_at(F.array(*[F.lit(n) for n in config.STATE_NAMES]), code + 1).alias("state_name"),
        (F.col("u") * 4 + F.when(code.isin(3, 4), 2.5).otherwise(0.0)).alias("gearbox_oil_temp"),
        F.cos(F.col("id").cast("double")).alias("wind_speed"), F.lit(1.0).alias("hydraulic_temp"),
    )


@pytest.fixture(scope="module")
def table(processed):
    return experiments.prepare(processed, config.experiment("pre_24h"))


def test_prepare(table):
    df, columns = table
    assert columns == ["gearbox_oil_temp", "wind_speed", "hydraulic_temp"] and df.columns == ["features", "label", "split"]
    assert {r[0] for r in df.select("split").distinct().collect()} == {"train", "val", "test"}


@pytest.mark.parametrize("name", ["logistic", "rf", "gbt"])
def test_models_learn_tune_and_rank(table, name):
    df, columns = table
    run = experiments.run_model(name, df, columns, config.experiment("pre_24h"), **SHORT[name])
    assert run.summary["roc_auc"] > 0.85 and 0 < run.model.threshold < 1
    assert run.summary["threshold"] == run.model.threshold and run.model.tuning["optimize_for"] == "f1"
    top = training.top_features(run.importance(), 1).first()
    assert top["feature"] == "gearbox_oil_temp" and run.importance().count() == 3
    again = experiments.run_model(name, df, columns, config.experiment("pre_24h"), **SHORT[name])
    assert again.summary == run.summary
    predicted = run.model.predict(splits.parts(df, "test"))
    assert predicted.filter(F.col("y_pred") != (F.col("y_prob") >= run.model.threshold).cast("int")).count() == 0
    assert run.model.predict(df, 1.0).filter("y_pred = 1").count() == 0
    kept = run.model.threshold
    assert run.model.refit(splits.parts(df, "train", "val")).threshold == kept


def test_logistic_solves_the_weighted_penalised_problem(spark):
    """Gradient of 1/2 |w|^2 + C sum s_i loss_i vanishes on population-scaled inputs."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) * [1.0, 5.0] + [3.0, -2.0]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=400) > 3.4).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a double, b double, target int")
    model = training.FaultModel("logistic", {"C": 0.5}).fit(selection.assemble(df, ["a", "b"]))
    rows = {r["feature"]: r["coefficient"] for r in model.importance(["a", "b"]).collect()}
    w = np.array([rows["a"], rows["b"]])
    z = (x - x.mean(0)) / x.std(0)
    s = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    p = 1 / (1 + np.exp(-(z @ w + model.fitted.stages[-1].intercept)))
    gradient = w + 0.5 * z.T @ (s * (p - y))
    assert np.abs(gradient).max() < 0.05


def test_training_errors(spark, table):
    df, _ = table
    model = training.FaultModel("logistic", {"max_iter": 5})
    with pytest.raises(ValueError, match="fit"):
        model.score(df)
    with pytest.raises(ValueError, match="NULL"):
        model.fit(df.withColumn("label", F.when(F.col("split") == "train", F.col("label"))))
    with pytest.raises(ValueError, match="0 or 1"):
        model.fit(df.withColumn("label", F.col("label") + 1))
    with pytest.raises(ValueError, match="model type"):
        training.FaultModel("svm")
    with pytest.raises(ValueError, match="optimize_for"):
        model.tune(df, "accuracy")


def test_class_weights_reach_the_solver():
    assert training.FaultModel("xgboost").params["n_estimators"] == 200
    assert config.model_params("xgboost")["learning_rate"] == 0.05
    assert math.isclose(config.model_params("rf", max_depth=3)["max_depth"], 3)


def test_experiment_run_saves_everything(spark, processed, tmp_path):
    board, runs = experiments.run_experiment(
        processed, "pre_24h", models=("logistic", "rf"), output=str(tmp_path), run_id="r1", overrides=SHORT
    )
    rows = board.collect()
    assert [r["f1"] for r in rows] == sorted((r["f1"] for r in rows), reverse=True) and rows[0]["n_features"] == 3
    saved = writers.load_table(spark, str(tmp_path / "threshold_sweep"))
    assert saved.filter("experiment = 'pre_24h' AND run_id = 'r1'").count() == 2 * 55
    meta = writers.load_json(spark, str(tmp_path / "model_metadata"))
    assert {r["model_name"] for r in meta.collect()} == {"logistic", "rf"}
    assert spark.read.option("header", True).csv(str(tmp_path / "feature_importance")).count() == 6
    assert spark.read.option("header", True).csv(str(tmp_path / "detailed_metrics")).count() == 2
    sweep = writers.load_table(spark, str(tmp_path / "best_model_test_sweep"))
    assert sweep.count() == 55 and {r[0] for r in sweep.select("model_name").distinct().collect()} == {rows[0]["model_name"]}


def test_feature_options_and_pruned_copy(processed):
    extra = processed.withColumn("label_text", F.lit("x"))
    table, columns = experiments.prepare(extra, config.experiment("pre_24h"), features={"include": ["wind_speed", "gearbox_oil_temp"], "extra_excluded": ["wind_speed"]})
    assert columns == ["gearbox_oil_temp"]
    plan = table.select("label")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<label:int>" in plan


def test_tournament(table):
    df, columns = table
    experiment = config.experiment("pre_24h", models=("logistic", "rf"))
    results, runs = experiments.tournament(df, columns, experiment, overrides=SHORT)
    rows = results.collect()
    assert [r["model_name"] for r in rows] == [r.name for r in runs] and rows[0]["test_f1"] >= rows[1]["test_f1"]
    assert rows[0]["train_recall"] is not None and experiments.snapshot(runs[0]).first()["f1"] == rows[0]["test_f1"]


def test_parts_are_partitions_of_the_prepared_table(table):
    df, _ = table
    for name in ("train", "val", "test"):
        plan = splits.parts(df, name)._jdf.queryExecution().executedPlan().toString()
        assert "split#" in plan.split("PartitionFilters: [")[1].split("]")[0] and f"= {name})" in plan


def test_tournament_scores_once_and_equals_single_runs(spark, table):
    df, columns = table
    experiment = config.experiment("pre_24h")
    board, runs = experiments.tournament(df, columns, experiment, overrides=SHORT)
    rows = {r["model_name"]: r for r in board.collect()}
    assert set(rows) == set(experiment.models) and runs[0].name == board.first()["model_name"]
    for run in runs:
        row = rows[run.name]
        for part in ("train", "val", "test"):
            alone = run.model.evaluate_detailed(splits.parts(df, part)).first()
            for m in ("precision", "recall", "f1"):
                assert row[f"{part}_{m}"] == pytest.approx(alone[m])
        assert row["test_roc_auc"] == pytest.approx(alone["roc_auc"]) and row["threshold"] == run.model.threshold
        val = run.model.score(splits.parts(df, "val"))
        assert run.model.tuning["f1"] == pytest.approx(metrics.best_threshold(val, "label", "y_prob").first()["f1"])
    sweep = experiments.winner_sweep(runs[0])
    assert sweep.count() == len(metrics.default_thresholds()) and sweep.first()["model_name"] == runs[0].name


def test_trees_answer_a_level_in_one_pass(spark):
    """A fit's jobs grow with the depth, not with nodes or forest; margins summed anew are the margins carried along."""
    from windvane.plans import trees

    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > -0.2)).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, target int").repartition(3)
    table = selection.assemble(df, ["a", "b", "c"])
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for count in (3, 40):
        spark.sparkContext.setJobGroup(f"forest-{count}", "")
        forest = training.FaultModel("rf", {"n_estimators": count, "max_depth": 4}).fit(table)
        jobs[count] = len(tracker.getJobIdsForGroup(f"forest-{count}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[40] == jobs[3]
    assert forest.evaluate(table).first()["roc_auc"] > 0.95
    params = {"n_estimators": 7, "max_depth": 3, "subsample": 0.8}
    carried = training.FaultModel("gbt", params).fit(table).fitted.model
    kept, trees.CHAIN = trees.CHAIN, 2
    try:
        anew = training.FaultModel("gbt", params).fit(table).fitted.model
    finally:
        trees.CHAIN = kept
    assert (carried.feature == anew.feature).all() and (carried.cut == anew.cut).all()
    assert carried.value == pytest.approx(anew.value)


def test_logistic_reaches_the_optimum_of_collinear_inputs(spark):
    """Newton steps end at the optimum itself, in a few passes, also with inputs that nearly repeat each other and one that is constant."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=500) + 1e6
    x = np.column_stack([a, 2 * a + 1e-3 * rng.normal(size=500), np.full(500, 0.1)])
    y = (a - 1e6 + rng.normal(size=500) > 1).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, target int")
    model = training.FaultModel("logistic", {"C": 10.0}).fit(selection.assemble(df, ["a", "b", "c"]))
    w = np.array([r["coefficient"] for r in model.importance(["a", "b", "c"], sort=False).collect()])
    z = np.column_stack([(x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0), np.zeros(500)])
    s = np.where(y == 1, 500 / (2 * y.sum()), 500 / (2 * (500 - y.sum())))
    p = 1 / (1 + np.exp(-(z @ w + model.fitted.intercept)))
    assert np.abs(w + 10 * z.T @ (s * (p - y))).max() < 1e-3 and abs((s * (p - y)).sum()) < 1e-3
    assert w[2] == 0 and model.fitted.passes <= 15
    one = training.FaultModel("logistic").fit(selection.assemble(df.filter("target = 1"), ["a", "b", "c"]))
    assert one.score(selection.assemble(df, ["a", "b", "c"])).filter("y_prob < 1").count() == 0


def test_boosted_trees_do_not_depend_on_partitions(spark):
    """Counts are whole numbers and pulls lie on a grid, so sums and the siblings' differences are exact in any order."""
    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, size=(4000, 5)) / 7
    y = (x[:, 0] * x[:, 1] + rng.normal(size=4000) > 3.1).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, e double, target int")
    found = []
    for parts in (2, 7):
        table = selection.assemble(df.repartition(parts), ["a", "b", "c", "d", "e"])
        found.append(training.FaultModel("gbt", {"n_estimators": 5, "max_depth": 8, "colsample": 0.6}).fit(table).fitted.model)
    for name in ("feature", "cut", "value", "gain"):
        assert (getattr(found[0], name) == getattr(found[1], name)).all(), name
    assert (found[0].feature[:, 127:] >= 0).any()


@pytest.mark.parametrize("together", [1, 2, 3])
def test_joint_cells_give_every_feature_its_sums(together):
    from windvane.plans import trees

    rng = np.random.default_rng(together)
    bins, node, y, pull = rng.integers(0, 32, (8, 900)).astype(np.uint8), rng.integers(0, 2, 900), rng.integers(0, 2, 900), rng.normal(size=900)
    cells = 32**together
    one = np.array([1.0, trees.CLASS_1])[y]
    joint = np.array([[np.bincount(node * cells + code, w, 2 * cells) for code in trees._codes(trees._words(bins), together)] for w in (one, pull)])
    sums = trees._by_feature(joint, together, 8)
    for f in range(8):
        for k, w in enumerate((y == 0, y == 1, pull)):
            assert sums[:, f, :, k].ravel() == pytest.approx(np.bincount(node * 32 + bins[f], w, 64))


def test_rows_are_led_alike_by_columns_and_by_node():
    from windvane.plans import trees

    rng = np.random.default_rng(2)
    bins = rng.integers(0, 32, (7, 500)).astype(np.uint8)
    feature = np.where(rng.random(511) < 0.85, rng.integers(0, 7, 511), -1).astype(np.int16)
    feature[255:] = -1
    cut = rng.integers(0, 31, 511).astype(np.uint8)
    plain = np.zeros(500, int)
    for row in range(500):
        while feature[plain[row]] >= 0:
            plain[row] = 2 * plain[row] + 1 + (bins[feature[plain[row]], row] > cut[plain[row]])
    assert (trees._swept_words(feature, cut, trees._words(bins), 8) == plain).all()
    at, node = trees._leaves(feature, cut, bins)
    assert (node[np.argsort(at)] == plain).all() and len(at) == 500
    at, node = trees._leaves(feature, cut, bins, np.arange(0, 500, 3), 4)
    shown = [r for r in range(0, 500, 3) if plain[r] >= 15]
    assert sorted(at) == shown and ((node >= 15) & (node < 31)).all()


def test_bin_bounds_lie_close_to_the_quantiles(spark):
    """Ranks of bounds are off by at most one in ``POINTS``; few values are parted in the middle."""
    from windvane.plans import trees

    n = 200_003
    rows = spark.range(n, numPartitions=2).select(F.array((F.col("id") * 7919 % n).cast("double"), (F.col("id") % 5).cast("double"), F.lit(2.5)).alias("x"))
    many, few, one = trees.thresholds(rows, 3)
    assert len(many) == trees.BINS - 1 and np.abs((many + 1) / n - np.arange(1, trees.BINS) / trees.BINS).max() <= 1 / trees.POINTS
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and not len(one)
    small = trees.thresholds(rows.filter("x[0] < 64").repartition(5), 3)[0]
    assert small.tolist() == [2 * i + 1.0 for i in range(31)]
