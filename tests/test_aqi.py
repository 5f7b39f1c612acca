from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from hazeline.functions.aqi import aqi_category, aqi_subindex
from hazeline.operators import aqi
from hazeline.operators.chunks import HOURLY_GRID


def values(spark, numbers):
    rows = [(i, None if v is None else float(v)) for i, v in enumerate(numbers)]
    return spark.createDataFrame(rows, "i int, v double").orderBy("i")


def test_breakpoints(spark):
    df = values(spark, [9.0, 9.09, 9.1, 35.4, 35.5, 125.4, 125.5, 600.0, None])
    got = [r[0] for r in df.select(aqi_subindex("v", "pm2_5")).collect()]
    assert got == [50, 50, 51, 100, 101, 200, 201, 500, None]


def test_below_first_row_has_no_index(spark):
    got = values(spark, [0.1, 0.125, 0.7]).select(aqi_subindex("v", "ozone_1h")).collect()
    assert [r[0] for r in got] == [None, 101, 500]


def test_categories(spark):
    df = values(spark, [50, 100, 100.5, 150, 200, 300, 301, 700, -1.0, None])
    got = [r[0] for r in df.select(aqi_category("v")).collect()]
    assert got == [
        "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
        "Very Unhealthy", "Hazardous", "Hazardous", None, None,
    ]


def test_negative_fails_or_is_null(spark):
    df = values(spark, [-1.0])
    assert df.select(aqi_subindex("v", "pm10", "null")).first()[0] is None
    with pytest.raises(Exception, match="negative"):
        df.select(aqi_subindex("v", "pm10")).collect()
    with pytest.raises(KeyError):
        aqi_subindex("v", "lead")


def test_constant_day(hours):
    row = aqi.daily_aqi(hours(24, pm2_5=35.4, pm10=254.0)).first()
    assert (row["aqi_pm2_5"], row["aqi_pm10"], row["aqi_us_epa"]) == (100, 150, 150)
    assert row["dominant_pollutant"] == "pm10"
    assert row["aqi_category"] == "Unhealthy for Sensitive Groups"


def test_partial_day_has_no_particle_index(hours):
    row = aqi.daily_aqi(hours(23, pm2_5=35.4, nitrogen_dioxide=10.0)).first()
    assert row["aqi_pm2_5"] is None and row["dominant_pollutant"] == "nitrogen_dioxide"


def test_ozone_needs_eight_hours(hours):
    got = aqi.hourly_subindices(hours(8, ozone=137.43)).orderBy("time").collect()
    assert [r["aqi_ozone"] for r in got] == [None] * 7 + [100]


def test_missing_value_breaks_the_window(hours):
    df = hours(30, pm2_5=lambda i: None if i == 3 else 9.0)
    got = aqi.hourly_subindices(df).orderBy("time").collect()
    assert [i for i, r in enumerate(got) if r["aqi_pm2_5"] is not None] == [27, 28, 29]


def test_broken_cadence_fails(hours):
    with pytest.raises(Exception, match="complete hour cadence"):
        aqi.hourly_subindices(hours(24, skip=(5,), pm2_5=1.0)).collect()
    twice = hours(24, pm2_5=1.0).union(hours(1, pm2_5=1.0))
    with pytest.raises(Exception, match="duplicate"):
        aqi.hourly_subindices(twice).collect()
    with pytest.raises(ValueError, match="no pollutant"):
        aqi.hourly_subindices(hours(3, dust=1.0))


def test_chunks_do_not_change_results(hours):
    df = hours(
        24 * 9,
        start="2026-01-01T05:00:00",
        pm2_5=lambda i: (i * 37 % 101) / 2,
        ozone=lambda i: i * 53 % 211 + 0.5,
        nitrogen_dioxide=lambda i: i * 29 % 97 + 0.25,
    )
    small = replace(HOURLY_GRID, chunk_steps=24)
    for operator in (aqi.hourly_subindices, aqi.daily_aqi, aqi.describe_hourly_aqi):
        whole, parts = operator(df), operator(df, grid=small)
        assert whole.exceptAll(parts).count() == 0 == parts.exceptAll(whole).count()


def test_current_readings(hours):
    df = hours(48, pm2_5=30.0, pm10=80.0, ozone=20.0, temperature_2m=33.0, wind_speed_10m=18.0)
    now = aqi.current_conditions(df).first()
    assert (now["main_pollutant"], now["concentration"], now["temperature_2m"]) == ("pm2_5", 30, 33)
    assert now["relative_humidity_2m"] is None
    latest = aqi.current_aqi(df).first()
    assert latest["aqi"] == 90 and latest["category"] == "Moderate"


def test_plan_has_one_exchange(hours):
    df = hours(48, pm2_5=30.0, pm10=80.0)
    plan = aqi.daily_aqi(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_negative_readings_through_the_operators(hours):
    df = hours(72, pm2_5=lambda i: -5.0 if i == 30 else 9.0, nitrogen_dioxide=lambda i: -1.0 if i == 71 else 10.0)
    gone = hours(72, pm2_5=lambda i: None if i == 30 else 9.0, nitrogen_dioxide=lambda i: None if i == 71 else 10.0)
    for operator in (aqi.hourly_subindices, aqi.describe_hourly_aqi, aqi.daily_aqi, aqi.current_aqi):
        got, expected = operator(df, on_negative="null"), operator(gone)
        assert got.exceptAll(expected).count() == 0 == expected.exceptAll(got).count()
        with pytest.raises(ValueError):
            operator(df, on_negative="drop")
    with pytest.raises(Exception, match="negative"):
        aqi.hourly_subindices(df).collect()


def test_nan_is_missing(spark):
    from hazeline.functions.common import nan_to_null

    got = nan_to_null(values(spark, [float("nan"), 1.0])).select(F.col("v").isNull()).collect()
    assert [r[0] for r in got] == [True, False]
