"""Landed JSON responses of the provider, turned into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions.common import nan_to_null
from hazeline.schema import (
    AIR_COLUMNS,
    AIR_SOURCE,
    DATE,
    KEYS,
    TIME,
    TREND_COLUMNS,
    TREND_SOURCE,
    WEATHER_COLUMNS,
    WEATHER_SOURCE,
)

# Product name: (block of the response, variables, source label).
PRODUCTS = {
    "air": ("hourly", AIR_COLUMNS, AIR_SOURCE),
    "weather": ("hourly", WEATHER_COLUMNS, WEATHER_SOURCE),
    "trend": ("daily", TREND_COLUMNS, TREND_SOURCE),
}
REFERENCE_VARIABLE = "us_aqi"


def response_schema(block: str, variables, keys=KEYS) -> T.StructType:
    arrays = ", ".join(["time: array<string>", *[f"{v}: array<double>" for v in variables]])
    head = ", ".join(f"{k} string" for k in keys)
    return T._parse_datatype_string(f"{head}, timezone string, {block} struct<{arrays}>")


def read_responses(spark: SparkSession, path: str, block: str, variables, keys=KEYS) -> DataFrame:
    """One row per response file line; only the named variables are parsed."""
    return spark.read.schema(response_schema(block, variables, keys)).json(path)


def _zipped(raw: DataFrame, block: str, variables, keys) -> DataFrame:
    """Unfold the parallel arrays; a response without times, or with arrays of other lengths, fails the job."""
    unequal = "".join(
        f"WHEN size({block}.{v}) <> size({block}.time) THEN raise_error('{block} {v} and times differ in number') "
        for v in variables
    )
    times = (
        f"CASE WHEN {block}.time IS NULL "
        f"THEN raise_error('response lacks {block} times') {unequal}ELSE {block}.time END AS time"
    )
    arrays = [times, *[f"coalesce({block}.{v}, array()) AS {v}" for v in variables]]
    columns = ", ".join(["time", *variables])
    return raw.selectExpr(*keys, "timezone", *arrays).selectExpr(
        *keys, "timezone", f"inline(arrays_zip({columns}))"
    )


def response_to_rows(raw: DataFrame, block: str, variables, source: str, keys=KEYS) -> DataFrame:
    """Rows of an hourly or daily response with its source label."""
    rows = _zipped(raw, block, variables, keys)
    if block == "daily":
        when = F.col("time").cast("date").alias(DATE)
    else:
        when = F.to_timestamp_ntz(F.replace("time", F.lit("T"), F.lit(" "))).alias(TIME)
    out = rows.select(*keys, when, *variables, F.lit(source).alias("source"))
    return nan_to_null(out)


def product_rows(raw: DataFrame, product: str, keys=KEYS) -> DataFrame:
    block, variables, source = PRODUCTS[product]
    return response_to_rows(raw, block, variables, source, keys)


def forecast_response_to_rows(raw: DataFrame, keys=KEYS) -> DataFrame:
    """(time, aqi) pairs of a reference forecast, without missing values, to one decimal."""
    rows = _zipped(raw, "hourly", [REFERENCE_VARIABLE], keys)
    return rows.where(F.col(REFERENCE_VARIABLE).isNotNull()).select(
        *keys,
        F.to_timestamp_ntz(F.replace("time", F.lit("T"), F.lit(" "))).alias(TIME),
        F.bround(REFERENCE_VARIABLE, 1).alias("aqi"),
    )


def response_values(raw: DataFrame, block: str, variables, keys=KEYS) -> DataFrame:
    """Rows with the response's time zone, as the live check reads them."""
    return _zipped(raw, block, variables, keys)
