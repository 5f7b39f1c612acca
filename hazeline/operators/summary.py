"""Daily features, climatologies, trends and other summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.aqi import SUBINDEX_ORDER, aqi_category, subindex_name
from hazeline.functions.common import present
from hazeline.operators.aqi import AQI_REACH, add_subindices, daily_aggregates, finish_daily
from hazeline.operators.chunks import CHUNK, HOURLY_GRID, Chunked, Grid, cut, with_positions
from hazeline.schema import (
    BASE_COLUMNS,
    DAILY_AQI,
    DATE,
    HOURLY_AQI,
    KEYS,
    SUMMED_COLUMNS,
    TIME,
    TREND_COLUMNS,
)


def daily_features_of(chunked: Chunked) -> DataFrame:
    """Daily features of hourly rows that were cut with a halo of 23 hours."""
    keys = chunked.keys
    pollutants = present(chunked.df, SUBINDEX_ORDER)
    measures = present(chunked.df, BASE_COLUMNS)
    means = [
        F.coalesce(F.sum(c), F.lit(0.0)).alias(c) if c in SUMMED_COLUMNS else F.avg(c).alias(c)
        for c in measures
    ]
    hourly = chunked.then(add_subindices).own_rows()
    daily = hourly.groupBy(*keys, CHUNK, F.to_date(chunked.grid.column).alias(DATE)).agg(
        *means, F.count("pm2_5").alias("hour_count"), *daily_aggregates(pollutants)
    )
    return (
        finish_daily(daily, pollutants)
        .where(F.col("pm2_5").isNotNull() & F.col(DAILY_AQI).isNotNull())
        .select(
            *keys,
            DATE,
            *measures,
            "hour_count",
            *[subindex_name(p) for p in pollutants],
            DAILY_AQI,
            "aqi_category",
            "dominant_pollutant",
        )
    )


def daily_features(master: DataFrame, keys=KEYS, grid: Grid = HOURLY_GRID) -> DataFrame:
    """Daily measure means (sums for rain), hour count and daily AQI columns.

    One aggregate after one exchange yields both the measures and the indices.
    Days without PM2.5 or without an AQI are dropped.
    """
    keep = master.select(*keys, grid.column, *present(master, BASE_COLUMNS))
    return daily_features_of(cut(keep, grid, back=AQI_REACH, keys=keys))


def annual_weather(df: DataFrame, keys=KEYS, date: str = DATE) -> DataFrame:
    """Yearly means, precipitation sums and the strongest gust."""
    how = {"precipitation_sum": F.sum, "rain_sum": F.sum, "wind_gusts_10m_max": F.max}
    return df.groupBy(*keys, F.year(date).alias("year")).agg(
        *[
            F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
            if how.get(c) is F.sum
            else how.get(c, F.avg)(c).alias(c)
            for c in present(df, TREND_COLUMNS)
        ]
    )


def climatology(df: DataFrame, unit: str, value: str = "pm2_5", keys=KEYS) -> DataFrame:
    """Mean of ``value`` by calendar month (daily table) or hour (hourly table)."""
    part = {"month": lambda: F.month(DATE), "hour": lambda: F.hour(TIME)}[unit]()
    return df.groupBy(*keys, part.alias(unit)).agg(F.avg(value).alias(value))


def climatology_extremes(means: DataFrame, unit: str, value: str = "pm2_5", keys=KEYS) -> DataFrame:
    """Unit with the highest and lowest mean; ties go to the earlier unit."""
    high = F.max_by(F.struct(unit, value), F.struct(F.col(value), -F.col(unit)))
    low = F.min_by(F.struct(unit, value), F.struct(value, unit))
    found = means.groupBy(*keys).agg(high.alias("h"), low.alias("l"))
    return found.select(
        *keys,
        F.col(f"h.{unit}").alias(f"highest_{unit}"),
        F.col(f"h.{value}").alias(f"highest_{value}"),
        F.col(f"l.{unit}").alias(f"lowest_{unit}"),
        F.col(f"l.{value}").alias(f"lowest_{value}"),
    )


def tail(df: DataFrame, rows: int, grid: Grid, keys=KEYS) -> DataFrame:
    """The last ``rows`` rows of each series, found by position rather than by a full sort."""
    placed = with_positions(df, grid, keys, "_pos", "_n")
    return placed.where(F.col("_pos") >= F.col("_n") - rows).drop("_pos", "_n")


def aqi_category_counts(
    df: DataFrame, aqi: str, last: int | None = None, grid: Grid = HOURLY_GRID, keys=KEYS
) -> DataFrame:
    """Rows per AQI category, optionally over the last rows of each series only."""
    rows = df.select(*keys, grid.column, aqi)
    if last is not None:
        rows = tail(rows, last, grid, keys)
    return (
        rows.select(*keys, aqi_category(aqi).alias("aqi_category"))
        .where(F.col("aqi_category").isNotNull())
        .groupBy(*keys, "aqi_category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def describe_aqi(df: DataFrame, aqi: str = DAILY_AQI, time: str = DATE, keys=KEYS) -> DataFrame:
    """Count, mean, deviation, quartiles and range to one decimal, and the peak day.

    Index values are whole numbers up to 500, so exact quartiles keep little state.
    """
    one = lambda c: F.bround(c, 1)
    quartiles = F.percentile(aqi, F.lit([0.25, 0.5, 0.75]))
    # Of equal peaks the earliest day counts.
    peak = F.min_by(time, F.struct(-F.col(aqi), F.col(time)))
    found = df.where(F.col(aqi).isNotNull()).groupBy(*keys).agg(
        F.count(aqi).alias("count"),
        one(F.avg(aqi)).alias("mean"),
        one(F.stddev_samp(aqi)).alias("std"),
        F.min(aqi).alias("min"),
        quartiles.alias("_q"),
        F.max(aqi).alias("max"),
        peak.alias("peak_day"),
    )
    quarter = {f"p{p}": one(F.col("_q")[i]) for i, p in enumerate((25, 50, 75))}
    return found.withColumns(quarter).drop("_q")


def coverage_stats(daily: DataFrame, keys=KEYS) -> DataFrame:
    """Retained days, median hours per day and days with fewer than 20 hours."""
    return daily.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.percentile("hour_count", F.lit(0.5)).alias("median_hour_count"),
        F.count_if(F.col("hour_count") < 20).alias("short_days"),
    )


# Measures compared with the target.
CORRELATED_COLUMNS = (
    "pm2_5",
    "pm10",
    "ozone",
    "temperature_2m",
    "relative_humidity_2m",
    "wind_speed_10m",
    "precipitation",
    "surface_pressure",
    "cloud_cover",
)


def pollutant_correlations(df: DataFrame, target: str = "pm2_5", keys=KEYS) -> DataFrame:
    """Pearson correlation with ``target`` and its rank by strength."""
    others = [c for c in present(df, CORRELATED_COLUMNS) if c != target]
    row = df.groupBy(*keys).agg(*[F.corr(c, target).alias(c) for c in others])
    long = row.unpivot(list(keys), others, "variable", "correlation")
    strongest = Window.partitionBy(*keys).orderBy(F.abs("correlation").desc_nulls_last(), "variable")
    return long.withColumn("rank", F.row_number().over(strongest))


# Variables with a trend estimate.
TREND_VARIABLES = (
    "temperature_2m_mean",
    "temperature_2m_max",
    "temperature_2m_min",
    "precipitation_sum",
    "rain_sum",
    "wind_speed_10m_mean",
    "relative_humidity_2m_mean",
)


def _complete_years(annual: DataFrame, as_of_year: int, keys) -> DataFrame:
    variables = present(annual, TREND_VARIABLES)
    return annual.where(F.col("year") < as_of_year).unpivot(
        [*keys, "year"], variables, "variable", "value"
    )


def trend_per_decade(annual: DataFrame, as_of_year: int, keys=KEYS, edge: int = 5) -> DataFrame:
    """Slope per decade over complete years, and the means of the first and last five."""
    years = Window.partitionBy(*keys, "variable")
    long = _complete_years(annual, as_of_year, keys).withColumns(
        {
            "_first": F.row_number().over(years.orderBy("year")),
            "_last": F.row_number().over(years.orderBy(F.col("year").desc())),
        }
    )
    return long.groupBy(*keys, "variable").agg(
        (F.regr_slope("value", "year") * 10).alias("slope_per_decade"),
        F.avg(F.when(F.col("_first") <= edge, F.col("value"))).alias(f"first_{edge}y_mean"),
        F.avg(F.when(F.col("_last") <= edge, F.col("value"))).alias(f"last_{edge}y_mean"),
    )


def trend_line(annual: DataFrame, as_of_year: int, keys=KEYS) -> DataFrame:
    """Fitted value of each complete year with an observation."""
    long = _complete_years(annual, as_of_year, keys).where(F.col("value").isNotNull())
    # A series has one row per year and variable here.
    fit = Window.partitionBy(*keys, "variable")
    slope = F.regr_slope("value", "year").over(fit)
    level = F.regr_intercept("value", "year").over(fit)
    return long.withColumn("fitted", slope * F.col("year") + level)


def downsample(
    df: DataFrame, value: str, last: int, every: int, grid: Grid, keys=KEYS
) -> DataFrame:
    """Every ``every``-th non-null row of each series' last ``last`` rows."""
    recent = tail(df.select(*keys, grid.column, value), last, grid, keys).where(
        F.col(value).isNotNull()
    )
    # At most ``last`` rows per series are left to number.
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(grid.column))
    return (
        recent.withColumn("_rn", order)
        .where((F.col("_rn") - 1) % every == 0)
        .select(*keys, grid.column, F.bround(value, 1).alias("aqi"))
    )


# Rows kept and sampling step of the exported charts.
HOURLY_CHART = {"value": HOURLY_AQI, "last": 90 * 24, "every": 6, "grid": HOURLY_GRID}


def holdout_summary(evaluation: DataFrame, keys=KEYS, metrics=("rmse", "mae", "r2")) -> DataFrame:
    """Mean metrics per model and output group, to three decimals."""
    return evaluation.groupBy(*keys, "model", "group").agg(
        *[F.bround(F.avg(m), 3).alias(m) for m in metrics]
    )


def daily_holdout_pivot(evaluation: DataFrame, keys=KEYS, horizons=(1, 2, 3)) -> DataFrame:
    """RMSE per model with one column per horizon."""
    wide = evaluation.groupBy(*keys, "model").pivot("horizon_days", list(horizons)).agg(F.avg("rmse"))
    return wide.select(
        *keys, "model", *[F.bround(F.col(str(h)), 2).alias(f"{h}d_rmse") for h in horizons]
    )
