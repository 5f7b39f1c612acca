"""Hourly and daily inputs derived from the driver tables.

One hourly series per user of ``events`` and one daily series per supplier of
``lineitem``, so the derived tables grow with the given ones. Empty steps count
as zero; the operators themselves never impute. Amounts are whole cents and
factors powers of ten, so every value is exact in any engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.common import hour_floor
from hazeline.operators.chunks import DAILY_GRID, HOURLY_GRID, Grid
from hazeline.schema import (
    AIR_COLUMNS,
    AIR_SOURCE,
    BASE_COLUMNS,
    DAILY_AQI,
    DATE,
    TIME,
    TREND_COLUMNS,
    WEATHER_COLUMNS,
    WEATHER_SOURCE,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("bigint")


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as (series, hour, amount): several rows per hour, hours missing."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("series_id"),
        hour_floor(F.col("ts")).alias(TIME),
        cents("value").alias("amount"),
    )


def on_every_step(found: DataFrame, grid: Grid, block: int, values: list[str]) -> DataFrame:
    """``found`` (a row per series and step) with rows of zeros on all other steps of the whole range.

    Steps are filled in block by block: only blocks and the rows found are shuffled, into as many tasks as the session
    has shuffle partitions, and each task unfolds its own blocks. Rows without a time stay as they are.
    """
    step = grid.column
    spark = found.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.floor(grid.steps() / F.lit(block)).cast("bigint")
    span = found.agg(F.min(step).alias("lo"), F.max(step).alias("hi"))
    first, last = span.select("lo").scalar(), span.select("hi").scalar()
    numbers = span.select(F.floor(grid.steps(F.col("lo")) / block).alias("lo"), F.floor(grid.steps(F.col("hi")) / block).alias("hi"))
    blocks = F.sequence(numbers.select("lo").scalar(), numbers.select("hi").scalar())
    entry = F.struct(F.col(step), F.struct(*values).alias("v"))
    placed = found.select("series_id", number.alias("_block"), entry.alias("_e"))
    cells = (
        found.select("series_id")
        .distinct()
        .select("series_id", F.explode(blocks).alias("_block"))
        .withColumn("_e", F.lit(None).cast(placed.schema["_e"].dataType))
    )
    held = (
        placed.unionByName(cells)
        .repartition(tasks, "series_id", "_block")
        .groupBy("series_id", "_block")
        .agg(F.collect_list("_e").alias("_e"))
    )
    dated = F.expr(f"filter(_e, e -> e.{step} IS NOT NULL)")
    begin = grid.at(F.col("_block") * block)
    end = grid.at(F.col("_block") * block + (block - 1))
    steps = F.when(F.col("_block").isNull(), F.col(f"_e.{step}")).otherwise(
        F.sequence(F.greatest(begin, first), F.least(end, last), F.expr(f"interval 1 {grid.step}"))
    )
    undated = F.when(F.col("_block").isNull(), F.col("_e")[0]["v"])
    # A select of its own: next to explode, the map would be built again for every step.
    filled = held.select("series_id", F.map_from_entries(dated).alias("_m"), undated.alias("_u"), steps.alias("_s"))
    rows = filled.select("series_id", "_m", "_u", F.explode("_s").alias(step))
    at = F.when(F.col(step).isNull(), F.col("_u")).otherwise(F.try_element_at(F.col("_m"), F.col(step)))
    rows = rows.select("series_id", step, at.alias("_v"))
    return rows.select("series_id", step, *[F.coalesce(F.col("_v")[v], F.lit(0).cast("bigint")).alias(v) for v in values])


def hourly_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum, smallest and largest amount per series and hour of the whole range."""
    found = (
        event_hours(spark, sf_dir)
        .groupBy("series_id", TIME)
        .agg(
            F.count("amount").alias("c"), F.sum("amount").alias("s"), F.min("amount").alias("mn"), F.max("amount").alias("mx")
        )
    )
    return on_every_step(found, HOURLY_GRID, 24, ["c", "s", "mn", "mx"])


AIR_EXPRESSIONS = {
    "pm10": "floor(mx/1e1)*2e0",
    "pm2_5": "s/1e1",
    "carbon_monoxide": "s*2e0",
    "nitrogen_dioxide": "mx/5e1",
    "sulphur_dioxide": "mn/1e2",
    "ozone": "s*4e0/1e2",
    "aerosol_optical_depth": "mn/1e3",
    "dust": "s/1e3",
    "uv_index": "c*1e0",
}
WEATHER_EXPRESSIONS = {
    "temperature_2m": "1e1 + hour(time)",
    "relative_humidity_2m": "3e1 + (day(time)*7 + hour(time)*3) % 60",
    "dew_point_2m": "5e0 + hour(time) + day(time) % 5",
    "precipitation": "(c % 3)*1e0",
    "rain": "(c % 2)*1e0",
    "surface_pressure": "9e2 + s % 50",
    "cloud_cover": "(s*7 % 101)*1e0",
    "wind_speed_10m": "(s % 200)/1e1",
    "wind_direction_10m": "(s*13 % 360)*1e0",
    "wind_gusts_10m": "(s % 200)/1e1 + 5e0",
}


def _measures(columns, expressions):
    return [F.expr(expressions[c]).cast("double").alias(c) for c in columns]


def air_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_base(spark, sf_dir).select(
        "series_id", TIME, *_measures(AIR_COLUMNS, AIR_EXPRESSIONS), F.lit(AIR_SOURCE).alias("source")
    )


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_base(spark, sf_dir).select(
        "series_id",
        TIME,
        *_measures(WEATHER_COLUMNS, WEATHER_EXPRESSIONS),
        F.lit(WEATHER_SOURCE).alias("source"),
    )


def hourly_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both products of one base row, as the merged hourly table holds them."""
    expressions = {**AIR_EXPRESSIONS, **WEATHER_EXPRESSIONS}
    return hourly_base(spark, sf_dir).select(
        "series_id", TIME, *_measures(BASE_COLUMNS, expressions)
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier and ship day: number of lines and a tenth of their quantity."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("series_id"),
        F.to_date("l_shipdate").alias(DATE),
        F.round("l_quantity").cast("bigint").alias("quantity"),
    )
    found = lines.groupBy("series_id", DATE).agg(F.count("quantity").alias("n"), F.sum("quantity").alias("q"))
    return on_every_step(found, DAILY_GRID, 64, ["n", "q"]).select(
        "series_id",
        DATE,
        F.col("n").cast("double").alias(DAILY_AQI),
        (F.col("q") / F.lit(10.0)).alias("pm2_5"),
    )


TREND_EXPRESSIONS = {
    "temperature_2m_mean": "(t % 4000)/1e2",
    "temperature_2m_max": "(t % 4000)/1e2 + 5e0",
    "temperature_2m_min": "(t % 4000)/1e2 - 5e0",
    "precipitation_sum": "(n % 10)*1e0",
    "rain_sum": "(n % 7)*1e0",
    "wind_speed_10m_mean": "(t % 300)/1e1",
    "wind_gusts_10m_max": "(t % 300)/1e1 + 1e1",
    "relative_humidity_2m_mean": "(t % 100)*1e0",
}


def weather_trend_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation and order day, over the days that have orders."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias(DATE), cents("o_totalprice").alias("amount")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.concat(F.lit("n"), F.col("c_nationkey")).alias("series_id"), DATE)
        .agg(F.sum("amount").alias("t"), F.count(F.lit(1)).alias("n"))
        .select("series_id", DATE, *_measures(TREND_COLUMNS, TREND_EXPRESSIONS))
    )
