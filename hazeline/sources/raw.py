"""Raw product tables: landing, reading, high-water marks and increments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazeline.functions.common import nan_to_null
from hazeline.schema import KEYS, PROVIDER, TIME
from hazeline.sources.files import is_missing


def append_new_rows(
    old: DataFrame, new: DataFrame, on=(*KEYS, TIME), policy: str = "existing_wins"
) -> DataFrame:
    """Old rows plus the new rows at unseen keys, or the reverse for ``latest_wins``."""
    on = list(on)
    if policy == "existing_wins":
        return old.unionByName(new.join(old.select(*on), on, "left_anti"))
    if policy == "latest_wins":
        return new.unionByName(old.join(new.select(*on), on, "left_anti"))
    raise ValueError("policy is 'existing_wins' or 'latest_wins'")


def write_raw(
    df: DataFrame,
    path: str,
    purpose: str,
    provider: str,
    frequency: str,
    start_date: str,
    end_date: str,
    ingest_date: str,
) -> str:
    """Land one pull. Its range becomes part of the folder, as partition columns."""
    if provider != PROVIDER:
        raise ValueError(f"only provider={PROVIDER!r} is accepted")
    folder = f"{path}/purpose={purpose}/frequency={frequency}"
    labelled = df.withColumns(
        {
            "ingest_date": F.lit(ingest_date).cast("date"),
            "requested_start": F.lit(start_date).cast("date"),
            "requested_end": F.lit(end_date).cast("date"),
        }
    )
    labelled.write.partitionBy("ingest_date", "requested_start", "requested_end").mode(
        "append"
    ).parquet(folder)
    return folder


def read_raw(
    spark: SparkSession,
    path: str,
    schema,
    purpose: str,
    frequency: str = "hourly",
    on=(*KEYS, TIME),
) -> DataFrame:
    """All pulls of a product; where pulls overlap, the earliest ingested row stays."""
    folder = f"{path}/purpose={purpose}/frequency={frequency}"
    columns = [f.name for f in schema.fields]
    try:
        rows = spark.read.parquet(folder).select(*columns, "ingest_date", "requested_end")
    except AnalysisException as error:
        if is_missing(error):
            raise FileNotFoundError(f"no raw data in {folder}; land a pull first") from error
        raise
    # Copies of one key are the overlapping pulls of that hour.
    order = Window.partitionBy(*on).orderBy("ingest_date", "requested_end")
    return nan_to_null(
        rows.withColumn("_copy", F.row_number().over(order)).where("_copy = 1").drop("_copy", "ingest_date")
    )


def read_raw_csv(spark: SparkSession, path: str, schema, pattern: str = "*.csv") -> DataFrame:
    """All CSV files that match ``pattern``, with the columns named in their headers."""
    return nan_to_null(
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("pathGlobFilter", pattern)
        .csv(path)
    )


def high_water_mark(df: DataFrame, keys=KEYS, time: str = TIME) -> DataFrame:
    """Latest time per series; no row for a series without rows."""
    return (
        df.groupBy(*keys)
        .agg(F.max(time).alias("latest"))
        .where(F.col("latest").isNotNull())
    )


def incremental_range(marks: DataFrame, starts: dict[str, str], end_date: str, keys=KEYS) -> DataFrame:
    """Dates still to be pulled per series and product.

    ``marks`` has the latest time per series and product ("air", "weather" or
    "trend"), with a null where nothing was landed. A product continues on the
    day after its latest; everything restarts when air or weather has nothing,
    and nothing is pulled when both are up to date.
    """
    end = F.lit(end_date).cast("date")

    def latest(product: str):
        return F.max(F.when(F.col("product") == product, F.to_date("latest"))).alias(product)

    wide = marks.groupBy(*keys).agg(*[latest(p) for p in ("air", "weather", "trend")])
    restart = F.col("air").isNull() | F.col("weather").isNull()

    def begin(product: str):
        first = F.lit(starts[product]).cast("date")
        return F.when(restart | F.col(product).isNull(), first).otherwise(F.date_add(product, 1))

    wide = wide.select(*keys, restart.alias("_restart"), *[begin(p).alias(p) for p in starts])
    current = ~F.col("_restart") & (F.col("air") > end) & (F.col("weather") > end)
    ranges = wide.where(~current).unpivot(list(keys), list(starts), "product", "start")
    return ranges.select(
        *keys,
        "product",
        F.explode(F.when(F.col("start") <= end, F.sequence("start", end))).alias("date"),
    )
