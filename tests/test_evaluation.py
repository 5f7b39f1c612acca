from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazeline.operators import baselines, evaluation, registry, ridge, splits
from hazeline.operators.chunks import HOURLY_GRID
from hazeline.schema import HOURLY_AQI, OUTPUTS, TARGET_COLUMNS


def test_split_leaves_a_gap(hours):
    df = hours(200, value=float)
    for grid in (HOURLY_GRID, replace(HOURLY_GRID, chunk_steps=24)):
        got = splits.chronological_split(df, grid=grid)
        sizes = {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()}
        assert sizes == {"train": 88, "purged": 72, "test": 40}
        assert got.where("split = 'test'").agg(F.min("value")).first()[0] == 160
    with pytest.raises(ValueError):
        splits.chronological_split(df, gap=10)
    with pytest.raises(ValueError):
        splits.chronological_split(df, test_fraction=1.5)
    with pytest.raises(Exception, match="too short"):
        splits.chronological_split(hours(50, value=float)).collect()


def test_expanding_folds(hours):
    got = splits.rolling_origin_folds(hours(1000, value=float), n_splits=3, test_size=100)
    rows = got.groupBy("fold", "role").agg(F.min("value"), F.max("value")).orderBy("fold", "role").collect()
    assert [tuple(r) for r in rows] == [
        (1, "test", 700, 799), (1, "train", 0, 627), (2, "test", 800, 899),
        (2, "train", 0, 727), (3, "test", 900, 999), (3, "train", 0, 827),
    ]
    with pytest.raises(ValueError):
        splits.rolling_origin_folds(hours(10, value=float), n_splits=1)


def test_seasonal_ramp(hours):
    df = hours(200, **{HOURLY_AQI: float})
    rows = baselines.seasonal_persistence_forecast(df).orderBy("time").collect()
    name = lambda i: baselines.prediction("seasonal_persistence", TARGET_COLUMNS[i])
    origin = rows[72]
    assert (origin[name(0)], origin[name(23)]) == (49, 72)
    assert origin[name(24)] == sum(range(49, 55)) / 6
    assert rows[10][name(0)] is None


def pairs(spark):
    rows = [("a", t, p) for t, p in ((0.0, 0.0), (200.0, 150.0))]
    df = spark.createDataFrame(rows, "series_id string, y double, yhat double")
    return df.withColumns({"model": F.lit("m"), "output_index": F.explode(F.sequence(F.lit(0), F.lit(29)))})


def test_metric_pair(spark):
    got = evaluation.evaluate_outputs(pairs(spark)).collect()
    assert len(got) == 33 and all(r["mse"] == 1250 for r in got)
    row = got[0]
    assert row["mae"] == 25 and row["r2"] == 1 - 2500 / 20000
    assert row["category_accuracy"] == 0.5 and row["high_aqi_recall"] == 1
    assert row["category_macro_f1"] == pytest.approx(1 / 6)


def test_constant_truth(spark):
    rows = [("a", 5.0, 5.0), ("b", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "series_id string, y double, yhat double")
    got = {r["series_id"]: r["r2"] for r in evaluation.regression_metrics(df, ("series_id",)).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def grouped(spark, **rmse):
    rows = [("a", m, g, v, v) for m, v in rmse.items() for g in ("hourly_points", "six_hour_means")]
    return spark.createDataFrame(rows, "series_id string, model string, group string, rmse double, mae double")


def test_release_gate(spark):
    good = evaluation.release_gate(grouped(spark, ridge=9.0, xgboost=8.0, persistence=10.0)).first()
    assert good["pass"] and good["best_model"] == "xgboost" and good["groups_beaten"] == 2
    bad = evaluation.release_gate(grouped(spark, ridge=11.0, persistence=10.0)).first()
    assert not bad["pass"] and bad["groups_beaten"] == 0
    with pytest.raises(Exception, match="no candidate or no baseline"):
        evaluation.release_gate(grouped(spark, ridge=11.0)).collect()
    chosen = evaluation.select_model_by_group(grouped(spark, ridge=9.0, xgboost=8.0, persistence=1.0))
    assert {r["model"] for r in chosen.collect()} == {"xgboost"}
    default = evaluation.select_model_by_group(grouped(spark, persistence=1.0)).first()
    assert default["model"] == "ridge"


def test_registry(spark, tmp_path):
    def candidate(model, rmse):
        return spark.createDataFrame(
            [("aqi-hourly", model, {"hourly_points_rmse": rmse}, {"k": "v"})],
            "name string, model string, metrics map<string,double>, params map<string,string>",
        )

    root = str(tmp_path)
    with pytest.raises(LookupError):
        registry.champion(registry.read_registry(spark, root), "aqi-hourly")
    steps = [("ridge", 11.0, 1), ("worse", 12.0, None), ("same", 11.0, None), ("better", 10.0, 2)]
    for day, (model, rmse, version) in enumerate(steps):
        row = registry.register_model(spark, root, candidate(model, rmse), f"day-{day}").first()
        assert row["version"] == version and row["promoted"] == (version is not None)
    held = registry.champion(registry.read_registry(spark, root), "aqi-hourly").first()
    assert (held["model"], held["version"]) == ("better", 2)
    assert registry.list_models(registry.read_registry(spark, root)).first()["alias"] == "champion"


def closed_form(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(0))) / scale[:, None]
    return y.mean(0) - mean @ beta, beta


def regression_rows(hours, n=400):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(950, 20, n), rng.normal(0, 1, n), rng.normal(5, 3, n)])
    y = np.column_stack([x @ [0.1, 3.0, -1.0] + rng.normal(0, 2, n), x @ [0.0, 1.0, 2.0]])
    columns = {f"x{j}": (lambda i, j=j: float(x[i, j])) for j in range(3)}
    columns |= {f"y{j}": (lambda i, j=j: float(y[i, j])) for j in range(2)}
    return x, y, hours(n, **columns)


def test_ridge_matches_closed_form(hours):
    x, y, df = regression_rows(hours)
    names, targets = ["x0", "x1", "x2"], ["y0", "y1"]
    got = ridge.fit_ridge(df, names, targets, 10.0).orderBy("output").collect()
    level, beta = closed_form(x, y, 10.0)
    for k, row in enumerate(got):
        assert row["n_train"] == 400 and row["intercept"] == pytest.approx(level[k], abs=1e-7)
        assert [row[ridge.coefficient(n)] for n in names] == pytest.approx(list(beta[:, k]), abs=1e-9)


def test_penalty_search_matches_brute_force(hours):
    x, y, df = regression_rows(hours)
    names, targets, alphas = ["x0", "x1", "x2"], ["y0", "y1"], (0.1, 10.0, 300.0)
    got = ridge.select_ridge_alpha(df, names, targets, alphas).first()
    scores = []
    for alpha in alphas:
        errors = []
        for start in (100, 200, 300):
            level, beta = closed_form(x[: start - 72], y[: start - 72], alpha)
            fitted = level + x[start : start + 100] @ beta
            errors.append(((fitted - y[start : start + 100]) ** 2).mean())
        scores.append(np.mean(errors))
    assert got["alpha"] == alphas[int(np.argmin(scores))]
    assert got["cv_mse"] == pytest.approx(min(scores), rel=1e-8)


def test_predict_and_attribution(hours):
    x, y, df = regression_rows(hours)
    names = ["x0", "x1", "x2"]
    models = ridge.fit_ridge(df, names, ["y0"], 1.0)
    predicted = ridge.predict(df, models, names).orderBy("time").collect()
    level, beta = closed_form(x, y[:, :1], 1.0)
    assert [r["yhat"] for r in predicted] == pytest.approx(list((level + x @ beta)[:, 0]), abs=1e-6)
    rows = ridge.linear_attribution(df, models, names, "y0", reference_rows=50).collect()
    expected = {n: beta[j, 0] * (x[-1, j] - x[-50:, j].mean()) for j, n in enumerate(names)}
    assert {r["feature"]: r["contribution"] for r in rows} == pytest.approx(expected, abs=1e-6)
    assert rows[0]["prediction"] == pytest.approx(predicted[-1]["yhat"], abs=1e-6)
    with pytest.raises(ValueError, match="lack trained"):
        ridge.predict(df.drop("x1"), models, names)
    assert len(OUTPUTS) == 30


def test_ridge_sums_are_shuffled_once_a_block(hours):
    """A series sends one row a block and task, with the sums a fit reads, where it sent a row a column."""
    df, names, targets = regression_rows(hours)[2], ["x0", "x1", "x2"], ["y0", "y1"]
    plan = ridge.FitPlan(gap=2, whole=True)
    parts, _ = ridge.gram_blocks(df, names, targets, plan, True)
    held = parts.collect()
    bounds = {b for b in plan.bounds(df.count(), int) if 0 < b < df.count()}
    assert len(held) <= len(bounds) + 1 + parts.rdd.getNumPartitions()
    wide = len(names) + 1
    assert {len(r["g"]) for r in held} == {8 * (wide * (wide + 1) // 2 + wide * len(targets) + len(targets))}
    assert sum(r["hi"] - r["lo"] + 1 for r in held) == df.count()
