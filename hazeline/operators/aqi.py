"""Hourly sub-indices, hourly and daily AQI, and the latest readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.aqi import (
    SUBINDEX_ORDER,
    aqi_category,
    dominant_pollutant,
    subindex_name,
    to_epa_units,
    with_subindices,
)
from hazeline.functions.common import greatest_of, present, snap_sql
from hazeline.operators.chunks import CHUNK, HOURLY_GRID, Chunked, Grid, cut, sums_name, without_offsets
from hazeline.schema import DAILY_AQI, DATE, HOURLY_AQI, KEYS, TIME

# Rows the longest concentration window looks back.
AQI_REACH = 23
# Averaging hours; gases without an entry use the hourly value.
AVERAGING_HOURS = {"pm2_5": 24, "pm10": 24, "carbon_monoxide": 8, "ozone": 8}
PARTICLES = ("pm2_5", "pm10")
# Concentrations are summed in billionths, which is exact for up to nine decimals.
CONCENTRATION_UNITS = 1e9


def subindex_columns(df: DataFrame) -> list[str]:
    return [subindex_name(p) for p in SUBINDEX_ORDER if p in df.columns]


def valid_readings(df: DataFrame, on_negative: str = "error") -> DataFrame:
    """The input, or with ``on_negative="null"`` the input with negative concentrations as missing.

    A missing reading leaves every averaging window and calendar day it lies in without an index.
    """
    if on_negative not in ("error", "null"):
        raise ValueError("on_negative is 'error' or 'null'")
    if on_negative == "error":
        return df
    return df.withColumns({p: F.expr(f"CASE WHEN {p} >= 0 THEN {p} END") for p in present(df, SUBINDEX_ORDER)})


def add_subindices(chunked: Chunked) -> DataFrame:
    """Add a sub-index column for every pollutant the chunked table has; guards the cadence."""
    df = chunked.df
    pollutants = present(df, SUBINDEX_ORDER)
    if not pollutants:
        raise ValueError("no pollutant column with an AQI table")
    averaged = [p for p in pollutants if p in AVERAGING_HOURS]
    chunked = chunked.guarded()
    summed = chunked.with_sums(averaged, CONCENTRATION_UNITS)
    summed = summed.with_offsets({sums_name(p): [-AVERAGING_HOURS[p]] for p in averaged})
    means = {
        f"_mean_{p}": F.expr(
            snap_sql(summed.summed_mean(p, 1 - AVERAGING_HOURS[p], 0, CONCENTRATION_UNITS))
        )
        for p in averaged
    }
    units = {
        f"_value_{p}": to_epa_units(f"_mean_{p}" if p in AVERAGING_HOURS else p, p)
        for p in pollutants
    }
    tables = {subindex_name(p): (f"_value_{p}", p) for p in pollutants if p != "ozone"}
    if "ozone" in pollutants:
        # Ozone takes the larger of its 8-hour and its 1-hour index.
        units["_value_ozone_1h"] = to_epa_units("ozone", "ozone")
        tables["_index_8h"] = ("_value_ozone", "ozone_8h")
        tables["_index_1h"] = ("_value_ozone_1h", "ozone_1h")
    df = summed.df.withColumns(means).withColumns(units)
    df = with_subindices(df, tables)
    if "ozone" in pollutants:
        df = df.withColumn(subindex_name("ozone"), F.greatest("_index_8h", "_index_1h"))
    return without_offsets(df.drop(*means, *units, *map(sums_name, averaged), "_index_8h", "_index_1h"))


def add_hourly_aqi(chunked: Chunked) -> DataFrame:
    df = add_subindices(chunked)
    return df.withColumn(
        HOURLY_AQI, F.expr(greatest_of(subindex_columns(chunked.df)))
    )


def hourly_subindices(
    df: DataFrame, keys=KEYS, grid: Grid = HOURLY_GRID, on_negative: str = "error"
) -> DataFrame:
    """Per hour the sub-index of each pollutant from its EPA averaging window.

    A negative mean or hourly gas reading fails the job, or with ``on_negative="null"`` negative readings are missing.
    """
    keep = [*keys, grid.column, *present(df, SUBINDEX_ORDER)]
    chunked = cut(valid_readings(df.select(*keep), on_negative), grid, back=AQI_REACH, keys=keys).then(add_subindices)
    return chunked.result().select(*keys, grid.column, *subindex_columns(df))


def with_hourly_aqi(df: DataFrame, keys=KEYS, grid: Grid = HOURLY_GRID) -> DataFrame:
    """The input plus ``aqi_hourly_rolling``, the largest sub-index of the hour."""
    chunked = cut(df, grid, back=AQI_REACH, keys=keys).then(add_hourly_aqi)
    return chunked.result().drop(*subindex_columns(df))


def describe_hourly_aqi(
    df: DataFrame, keys=KEYS, grid: Grid = HOURLY_GRID, on_negative: str = "error"
) -> DataFrame:
    """Hourly AQI with its category and dominant pollutant."""
    indices = hourly_subindices(df, keys, grid, on_negative)
    columns = subindex_columns(df)
    return indices.select(
        *keys,
        grid.column,
        F.expr(greatest_of(columns)).alias(HOURLY_AQI),
        dominant_pollutant(columns).alias("dominant_pollutant"),
    ).withColumn("aqi_category", aqi_category(HOURLY_AQI))


def daily_aggregates(pollutants: list[str]) -> list:
    """Aggregates of one day that :func:`finish_daily` turns into daily indices."""
    maxima = [
        F.max(subindex_name(p)).alias(subindex_name(p)) for p in pollutants if p not in PARTICLES
    ]
    means = [
        F.expr(f"CASE WHEN count({p}) = 24 THEN {snap_sql(f'avg({p})')} END AS _day_{p}")
        for p in pollutants
        if p in PARTICLES
    ]
    return maxima + means


def finish_daily(daily: DataFrame, pollutants: list[str]) -> DataFrame:
    """Particle indices from whole-day means, then AQI, category and dominant pollutant."""
    particles = [p for p in pollutants if p in PARTICLES]
    columns = [subindex_name(p) for p in pollutants]
    daily = with_subindices(daily, {subindex_name(p): (f"_day_{p}", p) for p in particles}).drop(
        *[f"_day_{p}" for p in particles]
    )
    daily = daily.withColumn(DAILY_AQI, F.expr(greatest_of(columns)))
    return daily.withColumns(
        {
            "aqi_category": aqi_category(DAILY_AQI),
            "dominant_pollutant": dominant_pollutant(columns),
        }
    )


def daily_aqi(
    df: DataFrame, keys=KEYS, grid: Grid = HOURLY_GRID, on_negative: str = "error"
) -> DataFrame:
    """Daily AQI per series.

    Gases take the day's largest hourly sub-index, particles the index of the
    calendar-day mean, which needs all 24 hours. Days never span chunks, so the
    daily aggregate reuses the exchange of the hourly windows.
    """
    pollutants = present(df, SUBINDEX_ORDER)
    keep = valid_readings(df.select(*keys, grid.column, *pollutants), on_negative)
    hourly = cut(keep, grid, back=AQI_REACH, keys=keys).then(add_subindices).own_rows()
    daily = hourly.groupBy(*keys, CHUNK, F.to_date(grid.column).alias(DATE)).agg(
        *daily_aggregates(pollutants)
    )
    columns = [subindex_name(p) for p in pollutants]
    return finish_daily(daily, pollutants).select(
        *keys, DATE, *columns, DAILY_AQI, "aqi_category", "dominant_pollutant"
    )


def last_rows(df: DataFrame, rows: int, keys=KEYS, time: str = TIME) -> DataFrame:
    """The ``rows`` latest rows of each series; Spark prunes them before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= rows).drop("_rank")


def _latest_with_indices(df: DataFrame, keys, extra: list[str], on_negative: str) -> DataFrame:
    """Latest row per series with its sub-indices, from the rows its windows need."""
    pollutants = present(df, SUBINDEX_ORDER)
    keep = df.select(*dict.fromkeys([*keys, TIME, *pollutants, *extra]))
    tail = valid_readings(last_rows(keep, AQI_REACH + 1, keys), on_negative)
    # At most 24 rows per series remain, so no chunking is needed.
    whole = Chunked(tail.withColumn(CHUNK, F.lit(0)), HOURLY_GRID, tuple(keys))
    return last_rows(whole.then(add_subindices).df.drop(CHUNK), 1, keys)


def _concentration(pollutants: list[str]):
    value = F.coalesce(
        *[F.when(F.col("main_pollutant") == p, F.col(p)) for p in pollutants]
    )
    return F.bround(value, 1)


def current_aqi(df: DataFrame, keys=KEYS, on_negative: str = "error") -> DataFrame:
    """AQI, category, dominant pollutant and its concentration at each series' last hour."""
    pollutants = present(df, SUBINDEX_ORDER)
    columns = [subindex_name(p) for p in pollutants]
    latest = _latest_with_indices(df, keys, [], on_negative)
    aqi = greatest_of(columns)
    return latest.withColumn(
        "main_pollutant", F.coalesce(dominant_pollutant(columns), F.lit("pm2_5"))
    ).select(
        *keys,
        F.expr(f"bround({aqi}, 1)").alias("aqi"),
        aqi_category(aqi).alias("category"),
        "main_pollutant",
        _concentration(pollutants).alias("concentration"),
    )


# Weather readings shown with the current conditions.
CONDITION_COLUMNS = ("temperature_2m", "relative_humidity_2m", "wind_speed_10m")


def current_conditions(df: DataFrame, keys=KEYS, on_negative: str = "error") -> DataFrame:
    """Latest weather readings with the dominant pollutant and its concentration."""
    pollutants = present(df, SUBINDEX_ORDER)
    columns = [subindex_name(p) for p in pollutants]
    readings = present(df, CONDITION_COLUMNS)
    latest = _latest_with_indices(df, keys, readings, on_negative)
    return latest.withColumn(
        "main_pollutant", F.coalesce(dominant_pollutant(columns), F.lit("pm2_5"))
    ).select(
        *keys,
        TIME,
        *[
            (F.bround(c, 1) if c in readings else F.lit(None).cast("double")).alias(c)
            for c in CONDITION_COLUMNS
        ],
        "main_pollutant",
        _concentration(pollutants).alias("concentration"),
    )
