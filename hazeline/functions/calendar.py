"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.common import cyclic
from hazeline.schema import DATE, LOCAL_ZONE, TIME


def add_hour_month_cycles(df: DataFrame, time: str = TIME) -> DataFrame:
    hour_sin, hour_cos = cyclic(F.hour(time), 24)
    month_sin, month_cos = cyclic(F.month(time), 12)
    return df.withColumns(
        {"hour_sin": hour_sin, "hour_cos": hour_cos, "month_sin": month_sin, "month_cos": month_cos}
    )


def add_hourly_calendar(df: DataFrame, time: str = TIME) -> DataFrame:
    """Hour, weekday and month cycles plus the weekend flag of the hourly contract."""
    day = F.weekday(time)
    dow_sin, dow_cos = cyclic(day, 7)
    return add_hour_month_cycles(df, time).withColumns(
        {"dow_sin": dow_sin, "dow_cos": dow_cos, "is_weekend": (day >= 5).cast("int")}
    )


def add_daily_calendar(df: DataFrame, date: str = DATE) -> DataFrame:
    day = F.weekday(date)
    month_sin, month_cos = cyclic(F.month(date), 12)
    year_sin, year_cos = cyclic(F.dayofyear(date), 365.25)
    return df.withColumns(
        {
            "month_sin": month_sin,
            "month_cos": month_cos,
            "dow": day,
            "is_weekend": (day >= 5).cast("int"),
            "day_of_year_sin": year_sin,
            "day_of_year_cos": year_cos,
        }
    )


def localise_time(
    df: DataFrame, column: str = TIME, zone: str = LOCAL_ZONE, source_zone: str = "UTC"
) -> DataFrame:
    """Turn instants given as naive ``source_zone`` times into naive local wall times."""
    local = F.convert_timezone(F.lit(source_zone), F.lit(zone), F.col(column).cast("timestamp_ntz"))
    return df.withColumn(column, local)
