from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hazeline.operators import features, merge, quality
from hazeline.operators.chunks import DAILY_GRID, HOURLY_GRID
from hazeline.schema import HOURLY_AQI, TARGET_COLUMNS, hourly_feature_columns


def test_targets_of_a_ramp(hours):
    rows = features.hourly_targets(hours(120, aqi_hourly_rolling=float)).orderBy("time").collect()
    first = rows[0]
    assert first["aqi_plus_01h"] == 1 and first["aqi_plus_24h"] == 24
    assert first["aqi_mean_25_30h"] == sum(range(25, 31)) / 6
    assert first["aqi_mean_49_60h"] == sum(range(49, 61)) / 12
    assert rows[48]["aqi_mean_61_72h"] is None and rows[47]["aqi_mean_61_72h"] is not None
    assert len(TARGET_COLUMNS) == 30


def test_block_with_a_missing_hour_is_null(hours):
    df = hours(120, aqi_hourly_rolling=lambda i: None if i == 27 else float(i))
    assert features.hourly_targets(df).orderBy("time").first()["aqi_mean_25_30h"] is None


def test_missing_observation_fails(hours):
    df = hours(30, pm2_5=lambda i: None if i == 5 else 1.0, nitrogen_dioxide=1.0)
    with pytest.raises(Exception, match="missing observed"):
        features.hourly_training_frame(df, include_targets=False).collect()
    with pytest.raises(ValueError, match="missing observed"):
        quality.require_complete(df, ["pm2_5"])


def test_frame_contract_and_chunks(full_hours):
    df = full_hours(300)
    frame = features.hourly_training_frame(df)
    expected = hourly_feature_columns(df.columns)
    assert frame.columns == ["series_id", "time", *expected, *TARGET_COLUMNS]
    assert len(expected) == 33 and frame.count() == 300 - 24 - 72
    parts = features.hourly_training_frame(df, grid=replace(HOURLY_GRID, chunk_steps=48))
    assert frame.exceptAll(parts).count() == 0 and parts.count() == frame.count()


def test_features_ignore_the_future(full_hours):
    df = full_hours(120)
    cut = datetime(2026, 1, 4)
    changed = df.withColumn("pm2_5", F.when(F.col("time") > F.lit(cut), 99.0).otherwise(F.col("pm2_5")))
    past = lambda d: features.hourly_training_frame(d, False).where(F.col("time") <= F.lit(cut))
    assert past(df).exceptAll(past(changed)).count() == 0 and past(df).count() > 0


def days(spark, n, skip=()):
    start = date(2026, 1, 1)
    rows = [("a", start + timedelta(days=i), float(i), i + 10.0) for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "series_id string, date date, aqi_us_epa double, pm2_5 double")


def test_daily_ramp(spark):
    frame = features.daily_training_frame(days(spark, 24)).orderBy("date")
    first = frame.first()
    assert (first["aqi_us_epa"], first["target_1d"], first["target_3d"]) == (7, 8, 10)
    assert first["aqi_us_epa_lag7"] == 0 and first["pm2_5_roll_mean3"] == 16
    assert frame.count() == 24 - 7 - 3
    small = features.daily_training_frame(days(spark, 24), grid=replace(DAILY_GRID, chunk_steps=4))
    assert frame.exceptAll(small).count() == 0


def test_daily_cadence(spark):
    with pytest.raises(ValueError, match="complete day cadence"):
        quality.require_daily_cadence(days(spark, 5, skip=(2,)))
    with pytest.raises(ValueError, match="duplicate"):
        quality.require_daily_cadence(days(spark, 5).union(days(spark, 1)))
    with pytest.raises(KeyError):
        features.daily_training_frame(days(spark, 5).drop("aqi_us_epa"))


def test_merge_renames_clashes(hours):
    air = hours(5, pm10=1.0, dust=2.0).withColumn("source", F.lit("a"))
    weather = hours(5, start="2026-01-01T01:00:00", dust=3.0, rain=0.0).withColumn("source", F.lit("w"))
    merged = merge.merge_air_weather(air, weather)
    assert merged.columns == ["series_id", "time", "pm10", "dust", "dust_weather", "rain"]
    assert merged.count() == 4
    with pytest.raises(Exception, match="duplicate"):
        merge.merge_air_weather(air.union(air), weather).collect()


def test_latest_window(hours):
    stored = hours(24 * 7, start="2026-08-09", pm2_5=30.0, pm10=40.0)
    fresh = hours(24 * 9, start="2026-08-09", pm2_5=31.0, pm10=41.0)
    as_of = "2026-08-16 12:10:00"
    got = features.latest_window(stored, as_of, fresh=fresh)
    last = got.orderBy(F.col("time").desc()).first()
    assert got.count() == 168 and last["time"] == datetime(2026, 8, 16, 12) and last["pm2_5"] == 31
    kept = features.latest_window(stored, "2026-08-15 23:59:00", fresh=fresh)
    assert kept.where("pm2_5 = 31").count() == 0
    holes = hours(200, pm2_5=lambda i: None if i > 190 else 1.0)
    done = features.latest_window(holes, "2027-01-01", drop_incomplete=True)
    assert done.where("pm2_5 IS NULL").count() == 0


def test_gap_report(hours):
    df = hours(10, skip=(3, 4), pm2_5=1.0).union(hours(1, pm2_5=1.0))
    row = quality.gap_report(df).first()
    assert (row["duplicates"], row["expected_hours"], row["missing_hours"]) == (1, 10, 2)
    lacking = sorted(r["time"].hour for r in quality.missing_steps(df).collect())
    assert lacking == [3, 4]
    assert HOURLY_AQI == "aqi_hourly_rolling"
