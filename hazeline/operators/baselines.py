"""Persistence forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.common import double
from hazeline.operators.chunks import HOURLY_GRID, Grid, cut
from hazeline.schema import HOURLY_AQI, KEYS, OUTPUTS, TARGET_COLUMNS


def prediction(model: str, output: str) -> str:
    return f"{model}__{output}"


def persistence_forecast(df: DataFrame, aqi: str = HOURLY_AQI) -> DataFrame:
    """Every output equals the current AQI."""
    return df.withColumns({prediction("persistence", o): F.col(aqi) for o in TARGET_COLUMNS})


def seasonal_lag(end_hour: int) -> int:
    """Hours looked back from the output: one, two or three days."""
    return 24 * -(-end_hour // 24)


SEASONAL_REACH = 23


def seasonal_persistence_forecast(
    df: DataFrame, aqi: str = HOURLY_AQI, keys=KEYS, grid: Grid = HOURLY_GRID, keep_chunks: bool = False
) -> DataFrame:
    """Every output repeats the same hours one, two or three days before it.

    Nothing after the origin is read; outputs without the history are null. Points and means read the
    same hours, so each is looked up once, by its offset. Rows that keep their chunk are split and
    folded without a further exchange.
    """

    def columns(c):
        backs = {name: range(seasonal_lag(end) - start, seasonal_lag(end) - end - 1, -1) for name, _, _, start, end in OUTPUTS}
        at = {k: f"_back_{k}" for k in sorted({k for found in backs.values() for k in found})}
        hours = c.df.withColumns({at[k]: c.lag(aqi, k) if k else F.col(aqi) for k in at})
        out = {}
        for name, found in backs.items():
            value = " + ".join(at[k] for k in found)
            out[prediction("seasonal_persistence", name)] = F.expr(
                value if len(found) == 1 else f"({value}) / {double(len(found))}"
            )
        return hours.withColumns(out).drop(*at.values())

    return cut(df, grid, back=SEASONAL_REACH, keys=keys).guarded().then(columns).result(keep_chunks)
