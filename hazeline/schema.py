"""Column contracts of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("series_id",)
TIME = "time"
DATE = "date"

# Measure names of the provider's products, in contract order.
AIR_COLUMNS = (
    "pm10",
    "pm2_5",
    "carbon_monoxide",
    "nitrogen_dioxide",
    "sulphur_dioxide",
    "ozone",
    "aerosol_optical_depth",
    "dust",
    "uv_index",
)
WEATHER_COLUMNS = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "precipitation",
    "rain",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
)
TREND_COLUMNS = (
    "temperature_2m_mean",
    "temperature_2m_max",
    "temperature_2m_min",
    "precipitation_sum",
    "rain_sum",
    "wind_speed_10m_mean",
    "wind_gusts_10m_max",
    "relative_humidity_2m_mean",
)
SUMMED_COLUMNS = ("precipitation", "rain")

# Provider, source labels and time zone.
PROVIDER = "open_meteo"
AIR_SOURCE = "open_meteo_air_quality"
WEATHER_SOURCE = "open_meteo_weather_features"
TREND_SOURCE = "open_meteo_weather_trend"
LOCAL_ZONE = "Asia/Karachi"

BASE_COLUMNS = AIR_COLUMNS + WEATHER_COLUMNS

# Names and hour ranges of the 30 outputs.
HOURLY_AQI = "aqi_hourly_rolling"
DAILY_AQI = "aqi_us_epa"
POINT_HOURS = tuple(range(1, 25))
SIX_HOUR_BLOCKS = ((25, 30), (31, 36), (37, 42), (43, 48))
TWELVE_HOUR_BLOCKS = ((49, 60), (61, 72))
MAX_FORECAST_HOURS = 72
MAX_FORECAST_DAYS = 3


def point_name(hour: int) -> str:
    return f"aqi_plus_{hour:02d}h"


def block_name(start: int, end: int) -> str:
    return f"aqi_mean_{start:02d}_{end:02d}h"


# (output, evaluation group, row kind, first hour, last hour) in output order.
OUTPUTS = tuple(
    [(point_name(h), "hourly_points", "point", h, h) for h in POINT_HOURS]
    + [(block_name(a, b), "six_hour_means", "six_hour_mean", a, b) for a, b in SIX_HOUR_BLOCKS]
    + [
        (block_name(a, b), "twelve_hour_means", "twelve_hour_mean", a, b)
        for a, b in TWELVE_HOUR_BLOCKS
    ]
)
TARGET_COLUMNS = tuple(o[0] for o in OUTPUTS)
GROUPS = ("hourly_points", "six_hour_means", "twelve_hour_means")

# Lags and windows of the feature frames.
HOURLY_LAGS = (1, 24)
HOURLY_WINDOWS = (6, 24)
DAILY_LAGS = (1, 2, 3, 7)
DAILY_WINDOWS = (3, 7)
DAILY_HORIZONS = (1, 2, 3)

TEMPORAL_COLUMNS = (
    "aqi_lag_1h",
    "aqi_lag_24h",
    "aqi_rolling_6h_mean",
    "aqi_rolling_24h_mean",
    "aqi_rolling_6h_std",
    "aqi_rolling_24h_std",
)
HOURLY_CALENDAR_COLUMNS = (
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "is_weekend",
    "month_sin",
    "month_cos",
)
DAILY_CALENDAR_COLUMNS = (
    "month_sin",
    "month_cos",
    "dow",
    "is_weekend",
    "day_of_year_sin",
    "day_of_year_cos",
)


def hourly_feature_columns(present) -> list[str]:
    """The ordered hourly feature contract for the measures that are present."""
    base = [c for c in BASE_COLUMNS if c in present]
    return [HOURLY_AQI, *base, *TEMPORAL_COLUMNS, *HOURLY_CALENDAR_COLUMNS]


def daily_feature_columns(present) -> list[str]:
    base = [c for c in BASE_COLUMNS if c in present]
    aqi, pm = DAILY_AQI, "pm2_5"
    return [
        *base,
        *[f"{aqi}_lag{k}" for k in DAILY_LAGS],
        *[f"{pm}_lag{k}" for k in DAILY_LAGS],
        *[f"{aqi}_roll_mean{k}" for k in DAILY_WINDOWS],
        *[f"{aqi}_roll_std{k}" for k in DAILY_WINDOWS],
        *[f"{pm}_roll_mean{k}" for k in DAILY_WINDOWS],
        *DAILY_CALENDAR_COLUMNS,
    ]


def hourly_schema(columns) -> T.StructType:
    return T.StructType(
        [T.StructField("series_id", T.StringType()), T.StructField(TIME, T.TimestampNTZType())]
        + [T.StructField(c, T.DoubleType()) for c in columns]
        + [T.StructField("source", T.StringType())]
    )


AIR_SCHEMA = hourly_schema(AIR_COLUMNS)
WEATHER_SCHEMA = hourly_schema(WEATHER_COLUMNS)
TREND_SCHEMA = hourly_schema(TREND_COLUMNS)
