"""Model registry: an append-only table of registrations.

A row is one attempt to register a model under a name. Promoted rows carry the
next version of the name, and the highest version is its champion.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.schema import KEYS
from hazeline.sources.files import read_if_present

REGISTRY_SCHEMA = (
    "name string, model string, version bigint, promoted boolean, reason string, "
    "metrics map<string,double>, params map<string,string>, registered_at string, run string"
)
# Registered names and the metric that decides.
HOURLY_MODEL = "aqi-hourly"
DAILY_MODELS = {1: "aqi-daily-h1", 2: "aqi-daily-h2", 3: "aqi-daily-h3"}
CHAMPION = "champion"
PRIMARY_METRIC = "hourly_points_rmse"


def flatten_metrics(grouped: DataFrame, metrics, keys=KEYS) -> DataFrame:
    """Metrics per output group as one map per model, keyed ``{group}_{metric}``."""
    pairs = F.array(
        *[
            F.struct(F.concat("group", F.lit(f"_{m}")).alias("key"), F.col(m).alias("value"))
            for m in metrics
        ]
    )
    return grouped.groupBy(*keys, "model").agg(
        F.map_from_entries(F.flatten(F.collect_list(pairs))).alias("metrics")
    )


def read_registry(spark: SparkSession, root: str) -> DataFrame:
    return read_if_present(spark, f"{root}/registry", REGISTRY_SCHEMA)


def champions(registry: DataFrame) -> DataFrame:
    """The champion row of every name."""
    newest = Window.partitionBy("name").orderBy(F.col("version").desc())
    return (
        registry.where("promoted")
        .withColumn("_rank", F.row_number().over(newest))
        .where("_rank = 1")
        .drop("_rank")
    )


def champion(registry: DataFrame, name: str) -> DataFrame:
    found = champions(registry.where(F.col("name") == name))
    if not found.limit(1).count():
        raise LookupError(f"no champion is registered for {name!r}")
    return found


def list_models(registry: DataFrame) -> DataFrame:
    """Latest version, its model and the alias of every name."""
    return champions(registry).select("name", "version", "model", F.lit(CHAMPION).alias("alias"))


def should_promote(
    new: DataFrame, registry: DataFrame, metric_key: str = PRIMARY_METRIC
) -> DataFrame:
    """Decision and reason per new row, by comparison with the champion of its name.

    Promote without a champion, without the metric on either side, or with a
    strictly lower metric.
    """
    held = champions(registry).select(
        "name", F.col("metrics").alias("_held"), F.col("version").alias("_version")
    )
    ours, theirs = (F.try_element_at(m, F.lit(metric_key)) for m in ("metrics", "_held"))
    gap = (F.col("_ours") - F.col("_theirs")) / F.col("_theirs") * 100
    compared = F.format_string("%.2f against %.2f of the champion (%+.1f%%)", "_ours", "_theirs", gap)
    unknown = F.col("_ours").isNull() | F.col("_theirs").isNull()
    return (
        new.join(held, "name", "left")
        .withColumns({"_ours": ours, "_theirs": theirs})
        .withColumn("promoted", unknown | (F.col("_ours") < F.col("_theirs")))
        .withColumn(
            "reason",
            F.when(F.col("_held").isNull(), "first of its name")
            .when(unknown, F.lit(f"{metric_key} unknown on one side"))
            .otherwise(compared),
        )
        .drop("_ours", "_theirs", "_held", "_version")
    )


def register_model(
    spark: SparkSession,
    root: str,
    new: DataFrame,
    registered_at: str,
    gate: bool = True,
    run: str | None = None,
) -> DataFrame:
    """Append ``new`` (name, model, metrics, params) and return the rows of this run.

    With ``gate`` a row gets a version only when it beats the champion; without
    it every row does. A ``run`` that is registered already is returned as it is,
    so a retried job adds nothing.
    """
    run = run or uuid.uuid4().hex
    registry = read_registry(spark, root)
    own = registry.where(F.col("run") == run)
    if not own.isEmpty():
        return own
    decided = should_promote(new, registry) if gate else new.withColumns(
        {"promoted": F.lit(True), "reason": F.lit("registered without a gate")}
    )
    last = registry.groupBy("name").agg(F.max("version").alias("_last"))
    order = Window.partitionBy("name", "promoted").orderBy("model")
    step = F.coalesce("_last", F.lit(0)) + F.row_number().over(order)
    rows = decided.join(last, "name", "left").select(
        "name",
        "model",
        F.when(F.col("promoted"), step).alias("version"),
        "promoted",
        "reason",
        "metrics",
        "params",
        F.lit(registered_at).alias("registered_at"),
        F.lit(run).alias("run"),
    )
    rows.write.mode("append").parquet(f"{root}/registry")
    return read_registry(spark, root).where(F.col("run") == run)


def registered_name() -> Column:
    """Name of the hourly model of a row's series."""
    return F.concat_ws("/", F.lit(HOURLY_MODEL), *KEYS)


def store_models(root: str, run: str, fits: DataFrame, trees: DataFrame | None = None) -> None:
    """Keep what a run has trained: ridge coefficients by ``name``, and the node tables of the trees.

    This comes before the run is registered, so a champion always finds its model, and what a failed run leaves
    behind belongs to no champion. A run's folders are written anew when it is repeated.
    """
    fits.write.mode("overwrite").parquet(f"{root}/registry_fits/run={run}")
    if trees is not None:
        trees.write.mode("overwrite").parquet(f"{root}/registry_trees/run={run}")


def champion_coefficients(spark: SparkSession, root: str) -> DataFrame:
    """Coefficients of every champion that is a ridge model, whatever was trained or rejected since."""
    held = champions(read_registry(spark, root)).where("model = 'ridge'").select("name", "version", "run")
    return spark.read.parquet(f"{root}/registry_fits").join(held, ["name", "run"])


def champion_trees(spark: SparkSession, root: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per run with champions that are boosted trees: their names, and the node tables they share.

    The driver holds the runs' ids: as many as there are trainings that still have a champion.
    """
    held = champions(read_registry(spark, root)).where("model = 'xgboost'")
    runs = sorted(r["run"] for r in held.select("run").distinct().collect())
    return {
        run: (held.where(F.col("run") == run).select("name"), spark.read.parquet(f"{root}/registry_trees/run={run}"))
        for run in runs
    }
