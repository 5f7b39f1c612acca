"""Gaps and duplicates fail every operator with row frames, wherever chunk edges fall."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hazeline.operators import aqi, baselines, features, summary
from hazeline.operators.chunks import DAILY_GRID, HOURLY_GRID
from hazeline.operators.merge import merge_air_weather, merge_cut
from hazeline.schema import AIR_COLUMNS, DAILY_AQI, DATE, HOURLY_AQI, TIME, WEATHER_COLUMNS

HOURLY = {
    "hourly_subindices": aqi.hourly_subindices,
    "with_hourly_aqi": aqi.with_hourly_aqi,
    "daily_aqi": aqi.daily_aqi,
    "daily_features": summary.daily_features,
    "hourly_training_frame": features.hourly_training_frame,
    "add_hourly_lag_roll": features.add_hourly_lag_roll,
    "hourly_targets": features.hourly_targets,
    "seasonal_persistence": baselines.seasonal_persistence_forecast,
}
DAILY = {
    "add_daily_lag_roll": features.add_daily_lag_roll,
    "daily_targets": features.daily_targets,
    "daily_training_frame": features.daily_training_frame,
}


@pytest.fixture(scope="module")
def hourly(full_hours):
    return lambda n, **k: full_hours(n, **k).withColumn(HOURLY_AQI, F.pmod(F.hour(TIME) * 7, F.lit(50)).cast("double")).cache()


@pytest.fixture(scope="module")
def daily(full_hours):
    def build(n, skip=()):
        days = full_hours(n, skip=skip).withColumn(DATE, F.expr(f"date_add(date'2026-01-01', cast(datediff(HOUR, timestamp_ntz'2026-01-01', {TIME}) AS int))"))
        return days.drop(TIME).withColumn(DAILY_AQI, F.col("pm2_5")).cache()

    return build


@pytest.mark.parametrize("name", HOURLY)
def test_hourly_gaps_and_duplicates(hourly, name):
    run, start = HOURLY[name], 240
    for steps, gap in ((24, 1), (48, 60), (240, 250), (4320, 1)):
        grid = replace(HOURLY_GRID, chunk_steps=steps)
        with pytest.raises(Exception, match="cadence"):
            run(hourly(700, skip=range(start, start + gap)), grid=grid).count()
    twice = hourly(100)
    with pytest.raises(Exception, match="duplicate"):
        run(twice.unionByName(twice.limit(1)), grid=replace(HOURLY_GRID, chunk_steps=24)).count()


@pytest.mark.parametrize("name", DAILY)
def test_daily_gaps_and_duplicates(daily, name):
    run = DAILY[name]
    for steps, gap in ((10, 1), (20, 45), (2048, 1)):
        with pytest.raises(Exception, match="cadence"):
            run(daily(120, skip=range(40, 40 + gap)), grid=replace(DAILY_GRID, chunk_steps=steps)).count()
    twice = daily(60)
    with pytest.raises(Exception, match="duplicate"):
        run(twice.unionByName(twice.limit(1)), grid=replace(DAILY_GRID, chunk_steps=10)).count()


@pytest.mark.parametrize("name", HOURLY)
def test_chunks_do_not_change_results(hourly, name):
    rows = hourly(400)
    whole = sorted(map(str, HOURLY[name](rows).collect()))
    assert sorted(map(str, HOURLY[name](rows, grid=replace(HOURLY_GRID, chunk_steps=48)).collect())) == whole


def test_merge_duplicates_fail_for_any_column(full_hours):
    rows = full_hours(72)
    air, weather = rows.select("series_id", TIME, *AIR_COLUMNS), rows.select("series_id", TIME, *WEATHER_COLUMNS)
    twice = air.unionByName(air.limit(1))
    merged = merge_air_weather(twice, weather)
    for read in (merged, merged.select(WEATHER_COLUMNS[0]), merged.select("series_id")):
        with pytest.raises(Exception, match="duplicate"):
            read.count()
    with pytest.raises(Exception, match="duplicate"):
        summary.daily_features_of(merge_cut(twice, weather, HOURLY_GRID, aqi.AQI_REACH)).count()


def test_labels_of_any_column_are_not_rounded(full_hours):
    rows = full_hours(100).withColumn("free", F.lit(0.0004)).withColumn(HOURLY_AQI, F.lit(0.0004))
    labels = features.hourly_targets(rows, aqi="free").first().asDict()
    assert {round(v, 12) for k, v in labels.items() if k not in ("series_id", TIME) and v is not None} == {0.0004}
    with pytest.raises(Exception, match="decimals"):
        features.add_hourly_lag_roll(rows).count() and features.add_hourly_lag_roll(rows).collect()
