"""The training job with both kinds of models, and forecasts by whichever is champion."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hazeline.operators import boosting, registry, splits
from hazeline.plans import jobs, testbed
from hazeline.plans import queries_products as queries
from hazeline.plans.catalog import AS_OF
from hazeline.schema import BASE_COLUMNS, KEYS, OUTPUTS, TIME, hourly_feature_columns

DATA = "/root/testdata/sf0.001"
FEATURES = hourly_feature_columns(BASE_COLUMNS)


@pytest.fixture(scope="module")
def trained(spark):
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return queries.trained(spark, DATA)


def test_every_fit_and_output_has_its_trees(trained):
    _, results = trained
    fits = results["trees"].groupBy("fit", "output").agg(F.countDistinct("tree").alias("n")).collect()
    assert {(r["fit"], r["output"]) for r in fits} == {(f, o) for f in ("holdout", "fold_1", "fold_2", "fold_3") for o in range(30)}
    assert {r["n"] for r in fits} == {queries.FEW_TREES.n_estimators + 1}
    models = {r["model"] for r in results["per_fold"].select("model").distinct().collect()}
    assert models == {"persistence", "seasonal_persistence", "ridge", "xgboost"}


def test_trees_beat_persistence(trained):
    # Hours of single events are noise, so no model beats the mean of the test rows by much.
    pooled = trained[1]["scores"].where("output = 'all' AND `group` = 'hourly_points'")
    rmse = {r["model"]: r["rmse"] for r in pooled.groupBy("model").agg(F.avg("rmse").alias("rmse")).collect()}
    assert rmse["xgboost"] < min(rmse["persistence"], rmse["seasonal_persistence"])


def test_windows_are_the_folds(spark, hours):
    frame = hours(700, v=lambda i: i)
    placed = jobs.with_positions(frame, jobs.HOURLY_GRID, pos="_pos", n="_n")
    windows = splits.training_windows(F.col("_pos"), F.col("_n"), 0.2, 3, 72)
    folds = splits.rolling_origin_folds(frame, 3, 72).where("role = 'train'")
    for k in (1, 2, 3):
        assert placed.where(windows[f"fold_{k}"]).count() == folds.where(F.col("fold") == k).count()
    assert placed.where(windows["holdout"]).count() == splits.chronological_split(frame).where("split = 'train'").count()


def test_champions_of_either_kind_forecast(spark, trained, tmp_path):
    source, results = trained
    root = str(tmp_path)
    for table in ("scores", "selected", "fits", "trees"):
        assert results[table] is not None
    # Half of the series choose trees, half ridge.
    even = F.crc32(F.col("series_id").cast("binary")) % 2 == 0
    chosen = results["selected"].withColumn("model", F.when(even, "xgboost").otherwise("ridge"))
    rows = jobs.register_hourly_job(spark, root, {**results, "selected": chosen}, "2024-02-01", run="one")
    assert rows.where("promoted").count() == rows.count() > 1
    kinds = {r["name"].split("/")[1]: r["model"] for r in registry.list_models(registry.read_registry(spark, root)).collect()}
    assert set(kinds.values()) == {"xgboost", "ridge"}

    latest = jobs.latest_features(testbed.hourly_master(spark, DATA), AS_OF).cache()
    models = registry.champion_coefficients(spark, root).drop("name", "version", "run")
    trees = registry.champion_trees(spark, root)
    got = {(r["series_id"], r["output"]): r["value"] for r in jobs.forecast_with(latest, models, trees, BASE_COLUMNS).collect()}
    assert len(got) == 30 * len(kinds)
    scored = boosting.score_trees(latest, results["trees"].where("fit = 'holdout'"), FEATURES, [*KEYS, TIME])
    for r in scored.collect():
        own = got[r["series_id"], OUTPUTS[r["output_index"]][0]]
        assert (own == pytest.approx(r["yhat"], abs=1e-12)) == (kinds[r["series_id"]] == "xgboost")

    # A rejected challenger leaves the champions' models in place, and a repeated run adds nothing.
    again = jobs.register_hourly_job(spark, root, {**results, "selected": chosen}, "2024-02-02", run="two")
    assert again.where("promoted").count() == 0
    assert jobs.register_hourly_job(spark, root, {**results, "selected": chosen}, "2024-02-02", run="two").count() == again.count()
    assert {t for t in registry.champion_trees(spark, root)} == {"one"}
