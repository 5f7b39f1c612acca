"""Small column helpers shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def double(value: float) -> str:
    """A number as a DOUBLE literal of SQL."""
    return f"{float(value)!r}D"


def fail_when(condition: Column, message: str, value: Column) -> Column:
    """``value``, but the job fails with ``message`` on a row where ``condition`` holds."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def snap_sql(value: str) -> str:
    """Drop the float noise of a mean, which would otherwise be truncated a step too low."""
    return f"(rint(({value}) * 1e9D) / 1e9D)"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing is null everywhere; float files may bring NaN."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def hour_floor(time: Column) -> Column:
    """Start of the hour, without a detour through a time zone."""
    return time - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(time), F.extract(F.lit("SECOND"), time)
    )


def hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def greatest_of(columns: list[str]) -> str:
    """Largest non-null value; one column passes through."""
    return columns[0] if len(columns) == 1 else f"greatest({', '.join(columns)})"


def any_null(columns) -> Column:
    return F.expr(" OR ".join(f"`{c}` IS NULL" for c in columns) or "false")


def present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]
