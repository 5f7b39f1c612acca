"""Whole jobs: feature build, training, registration, forecast and evaluation report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.common import present
from hazeline.operators import boosting, evaluation, products, registry, ridge, splits, summary, trees
from hazeline.operators.aqi import current_aqi, last_rows
from hazeline.operators.baselines import persistence_forecast, seasonal_persistence_forecast
from hazeline.operators.boosting import Boosting
from hazeline.operators.chunks import DAILY_GRID, HOURLY_GRID, with_positions
from hazeline.operators.evaluation import ALL_SQL
from hazeline.operators.features import hourly_training_frame, latest_window
from hazeline.operators.merge import merge_air_weather
from hazeline.operators.quality import require_complete, require_hourly_cadence
from hazeline.schema import (
    BASE_COLUMNS,
    DAILY_AQI,
    DAILY_HORIZONS,
    DATE,
    HOURLY_AQI,
    KEYS,
    OUTPUTS,
    TARGET_COLUMNS,
    TIME,
    hourly_feature_columns,
)
from hazeline.sources import store


def build_features_job(
    spark: SparkSession, air: DataFrame, weather: DataFrame, root: str, created_at: str
) -> DataFrame:
    """Merge, check and store the hourly tables and the daily training frame."""
    merged = f"{root}/merged"
    merge_air_weather(air, weather).write.mode("overwrite").parquet(merged)
    master = spark.read.parquet(merged)
    require_hourly_cadence(master)
    require_complete(master, present(master, BASE_COLUMNS))
    store.backfill_hourly(spark, master, root, source="merged", created_at=created_at)
    daily = summary.daily_features(master)
    return store.backfill_daily(spark, daily, root, source="merged", created_at=created_at)


def _baseline_cells(rows: DataFrame, keep) -> DataFrame:
    return evaluation.to_long(rows, ("persistence", "seasonal_persistence"), keep)


def _ridge_cells(rows: DataFrame, models: DataFrame, features, keep) -> DataFrame:
    """Ridge predictions next to the labels of the same rows, in one pass over them."""
    on = [k for k in keep if k in models.columns]
    labelled = rows.withColumn("_y", F.array(*TARGET_COLUMNS))
    both = ridge.predict(labelled, models, features, on, (*keep, "_y"))
    index = evaluation.INDEX
    return both.selectExpr(*keep, "'ridge' AS model", index, f"_y[{index}] AS y", "yhat")


def train_hourly_job(
    spark: SparkSession,
    root: str,
    n_splits: int = 3,
    test_size: int = 168,
    test_fraction: float = 0.2,
    boosted: Boosting | None = None,
    require_gate: bool = True,
) -> dict[str, DataFrame | None]:
    """Train and evaluate on the stored frame; write and return the result tables.

    Ridge gets all its fits (holdout and folds, each with its own penalty search)
    from one pass. ``boosted`` holds the settings of the boosted trees, whose
    ensembles for all outputs and all fits grow together over the rows of all
    series; None leaves them out.
    """
    frame = store.get_hourly_features(spark, root)
    features = [c for c in frame.columns if c not in (*KEYS, TIME, *TARGET_COLUMNS)]
    plan = ridge.FitPlan(holdout=test_fraction, folds=n_splits, test_size=test_size)
    fits = _table(ridge.ridge_fits(frame, features, TARGET_COLUMNS, plan), root, "ridge_fits")

    forecasts = persistence_forecast(seasonal_persistence_forecast(frame, keep_chunks=True))
    placed = splits.chronological_split(forecasts, test_fraction)
    holdout = placed.where(F.col("split") == "test")
    folds = splits.rolling_origin_folds(forecasts, n_splits, test_size)
    tests = folds.where(F.col("role") == "test")

    holdout_fit = fits.where(F.col("fit") == "holdout").drop("fit")
    fold_fits = fits.where(F.col("fit").startswith("fold_")).withColumn(
        "fold", F.substring_index("fit", "_", -1).cast("int")
    )
    cells = _baseline_cells(holdout, KEYS).unionByName(
        _ridge_cells(holdout, holdout_fit, features, KEYS)
    )
    by_fold = [*KEYS, "fold"]
    fold_cells = _baseline_cells(tests, by_fold).unionByName(
        _ridge_cells(tests, fold_fits.drop("fit"), features, by_fold)
    )
    candidates = ["ridge"]
    nodes = None
    if boosted is not None:
        candidates.append("xgboost")
        numbered = _table(with_positions(frame, HOURLY_GRID, pos="_pos", n="_n"), root, "numbered")
        windows = splits.training_windows(F.col("_pos"), F.col("_n"), test_fraction, n_splits, test_size)
        fitted = boosting.fit_boosted_outputs(numbered, features, TARGET_COLUMNS, windows, boosted)
        nodes = _table(fitted, root, "boosted_trees")
        cells = cells.unionByName(_tree_cells(holdout, nodes.where("fit = 'holdout'"), features, KEYS))
        for fold in range(1, n_splits + 1):
            fold_cells = fold_cells.unionByName(
                _tree_cells(tests.where(F.col("fold") == fold), nodes.where(F.col("fit") == f"fold_{fold}"), features, by_fold)
            )
    scores = _table(evaluation.evaluate_outputs(cells), root, "hourly_model_comparison")
    per_fold = _table(evaluation.evaluate_folds(fold_cells), root, "hourly_rolling_origin")
    rolling = evaluation.rolling_origin_evaluation(per_fold)
    gate = _table(evaluation.release_gate(rolling, candidates), root, "release_gate")
    if require_gate:
        failed = gate.where(~F.col("pass")).limit(1).collect()
        if failed:
            raise RuntimeError(f"release gate failed: {failed[0]['reason']}")
    selected = _table(evaluation.select_model_by_group(rolling, candidates), root, "selected_models")
    return {
        "fits": fits,
        "trees": nodes,
        "scores": scores,
        "per_fold": per_fold,
        "rolling": rolling,
        "gate": gate,
        "selected": selected,
    }


def _tree_cells(rows: DataFrame, nodes: DataFrame, features, keep) -> DataFrame:
    """Forecasts of the trees next to the labels of the same rows."""
    labelled = rows.withColumn("_y", F.array(*TARGET_COLUMNS))
    both = boosting.score_trees(labelled, nodes, features, (*keep, "_y"))
    index = evaluation.INDEX
    return both.selectExpr(*keep, "'xgboost' AS model", index, f"_y[{index}] AS y", "yhat")


# Hours a forecast is made from.
WINDOW_HOURS = 168


def _table(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write a result and go on from the written table."""
    path = f"{root}/results/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def train_daily_job(
    spark: SparkSession, root: str, spaces: dict | None = None, n_iter: int = 12
) -> dict[str, DataFrame]:
    """Persistence and searched models per horizon on the stored daily frame."""
    frame = store.get_daily_features(spark, root)
    targets = [f"target_{h}d" for h in DAILY_HORIZONS]
    features = [c for c in frame.columns if c not in (*KEYS, DATE, DAILY_AQI, *targets)]
    split = _table(splits.chronological_split(frame, grid=DAILY_GRID), root, "daily_split")
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    naive = test.selectExpr(
        "'persistence' AS model",
        f"{DAILY_AQI} AS yhat",
        "inline(array("
        + ", ".join(f"named_struct('horizon_days', {h}, 'y', target_{h}d)" for h in DAILY_HORIZONS)
        + "))",
    )
    scores = evaluation.regression_metrics(naive, ("model", "horizon_days")).select(
        "model", "horizon_days", "rmse", "mae", "r2", F.lit("{}").alias("params")
    )
    found = trees.search_daily_models(
        spark, train, test, features, spaces=spaces, n_iter=n_iter
    )
    comparison = _table(scores.unionByName(found), root, "model_comparison")
    best = evaluation.select_model_by_group(
        comparison, ("ridge", "random_forest", "xgboost"), by=("horizon_days",)
    )
    return {"comparison": comparison, "best": _table(best, root, "best_by_horizon")}


def register_hourly_job(
    spark: SparkSession,
    root: str,
    results: dict[str, DataFrame],
    registered_at: str,
    run: str | None = None,
) -> DataFrame:
    """Register the model chosen for the hourly points of each series, behind the champion gate.

    What the run has trained is kept first; the registry's rows then refer to the run.
    """
    run = run or uuid.uuid4().hex
    name = registry.registered_name()
    fits = results["fits"].where("fit = 'holdout'").drop("fit").withColumn("name", name)
    trees_ = results["trees"]
    registry.store_models(root, run, fits, None if trees_ is None else trees_.where("fit = 'holdout'").drop("fit"))
    pooled = results["scores"].where(F.col("output") == "all")
    metrics = registry.flatten_metrics(pooled, list(ALL_SQL))
    chosen = results["selected"].where(F.col("group") == "hourly_points").select(*KEYS, "model")
    sizes = results["fits"].where("fit = 'holdout'").groupBy(*KEYS).agg(
        F.max("n_train").alias("n_train"), F.max("alpha").alias("alpha")
    )
    new = (
        metrics.join(chosen, [*KEYS, "model"])
        .join(sizes, list(KEYS))
        .select(
            name.alias("name"),
            "model",
            "metrics",
            F.create_map(
                F.lit("selected_model"), F.col("model"),
                F.lit("n_train_rows"), F.col("n_train").cast("string"),
                F.lit("alpha"), F.col("alpha").cast("string"),
                F.lit("output_count"), F.lit(str(len(TARGET_COLUMNS))),
            ).alias("params"),
        )
    )
    return registry.register_model(spark, root, new, registered_at, run=run)


def register_daily_job(
    spark: SparkSession, root: str, results: dict[str, DataFrame], registered_at: str
) -> DataFrame:
    """Register the best daily model of every horizon."""
    names = F.create_map(
        *[F.lit(v) for h, n in registry.DAILY_MODELS.items() for v in (h, n)]
    )
    new = results["comparison"].join(results["best"], ["horizon_days", "model"]).select(
        names[F.col("horizon_days")].alias("name"),
        "model",
        F.map_from_arrays(
            F.array(*[F.lit(m) for m in ("rmse", "mae", "r2")]), F.array("rmse", "mae", "r2")
        ).alias("metrics"),
        F.create_map(F.lit("params"), F.col("params")).alias("params"),
    )
    return registry.register_model(spark, root, new, registered_at, gate=False)


def latest_features(hourly: DataFrame, as_of, fresh: DataFrame | None = None) -> DataFrame:
    """Features of the last hour of every series up to ``as_of``."""
    return window_features(latest_window(hourly, as_of, fresh=fresh))


def window_features(window: DataFrame) -> DataFrame:
    """Features of the last hour of every series in a window."""
    return last_rows(hourly_training_frame(window, include_targets=False), 1)


def forecast_latest(
    hourly: DataFrame, models: DataFrame, as_of, fresh: DataFrame | None = None
) -> DataFrame:
    """Ridge forecast from the last hour of every series up to ``as_of``."""
    return forecast_with(latest_features(hourly, as_of, fresh), models, {}, present(hourly, BASE_COLUMNS))


def forecast_with(
    latest: DataFrame, models: DataFrame, trees_: dict[str, tuple[DataFrame, DataFrame]], columns
) -> DataFrame:
    """Forecast of each series by its own model: coefficients in ``models`` or the trees of the run that names it."""
    features = hourly_feature_columns(columns)
    index = evaluation.INDEX
    predicted = ridge.predict(latest, models, features).select(*KEYS, TIME, index, "yhat")
    for names, nodes in trees_.values():
        rows = latest.withColumn("name", registry.registered_name()).join(names, "name", "left_semi")
        predicted = predicted.unionByName(boosting.score_trees(rows, nodes, features, (*KEYS, TIME)))
    info = ", ".join(
        f"named_struct('output', '{n}', 'kind', '{k}', 'first', {a}, 'last', {b})" for n, _, k, a, b in OUTPUTS
    )
    long = predicted.select(
        *KEYS, F.col(TIME).alias(products.ORIGIN), F.expr(f"array({info})[{index}]").alias("i"), F.col("yhat").alias("value")
    ).select(*KEYS, products.ORIGIN, "i.*", "value")
    return products.label_outputs(long)


def forecast_job(
    spark: SparkSession, root: str, reference: DataFrame, as_of, fresh: DataFrame | None = None
) -> DataFrame:
    """Forecast documents of all series with a champion, written below ``root``.

    The champion's own coefficients or trees forecast; a rejected challenger changes nothing. One window, read
    from the years that hold it, serves the forecast and the current AQI.
    """
    hourly = store.read_latest(spark, root, "hourly_raw", as_of, WINDOW_HOURS)
    window = _table(latest_window(hourly, as_of, WINDOW_HOURS, fresh=fresh), root, "window")
    models = registry.champion_coefficients(spark, root).drop("name", "version", "run")
    latest = _table(window_features(window), root, "latest")
    forecast = forecast_with(latest, models, registry.champion_trees(spark, root), present(hourly, BASE_COLUMNS))
    forecast = _table(forecast, root, "forecast")
    current = current_aqi(window)
    documents = products.forecast_document(forecast, current, reference, as_of, registry.HOURLY_MODEL)
    products.write_documents(documents, f"{root}/forecast")
    return documents


def evaluation_document(
    spark: SparkSession, root: str, output: str = TARGET_COLUMNS[0], top: int = 15
) -> dict[str, DataFrame]:
    """The parts of the evaluation report, from the stored results."""

    def results(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/results/{name}")

    hourly = store.get_hourly_features(spark, root)
    daily = store.get_daily_features(spark, root)
    scores = results("hourly_model_comparison").where(F.col("output") != "all")
    rolling = evaluation.rolling_origin_evaluation(results("hourly_rolling_origin"))
    fits = results("ridge_fits").where("fit = 'holdout'").drop("fit")
    observed = store.get_hourly_observations(spark, root)
    features = [c for c in observed.columns if c not in (*KEYS, TIME)]
    return {
        "registry": registry.list_models(registry.read_registry(spark, root)),
        "hourly_holdout": summary.holdout_summary(scores),
        "daily_holdout": summary.daily_holdout_pivot(results("model_comparison"), keys=()),
        "rolling_origin": summary.holdout_summary(
            rolling,
            metrics=("mse", "rmse", "mae", "r2", "category_accuracy", "high_aqi_recall"),
        ),
        "hourly_distribution": summary.aqi_category_counts(hourly, HOURLY_AQI, last=2160),
        "hourly_series": summary.downsample(hourly, HOURLY_AQI, 2160, 6, HOURLY_GRID),
        "daily_series": summary.downsample(daily, DAILY_AQI, 730, 7, DAILY_GRID),
        "attribution": ridge.linear_attribution(observed, fits, features, output, top=top),
    }


def write_evaluation(parts: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per part of the report."""
    for name, part in parts.items():
        part.write.mode("overwrite").json(f"{path}/{name}")


