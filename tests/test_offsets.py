"""Offsets looked up once, narrow stored frames, positions without another exchange."""

from __future__ import annotations

import re
from collections import Counter
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from hazeline.operators import features, splits
from hazeline.operators.chunks import CHUNK, DAILY_GRID
from hazeline.plans import catalog


def lookups(df):
    """How often the plan looks up each offset."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    return Counter(re.findall(r"(lag|lead)\((\S+), (-?\d+), ", plan))


def days(spark, n):
    rows = [(s, date(2024, 1, 1) + timedelta(days=i), float(i * i % 97), float(i % 13)) for s in "ab" for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, date date, aqi_us_epa double, pm2_5 double")


def test_hourly_frame_looks_an_offset_up_once(full_hours):
    found = lookups(features.hourly_training_frame(full_hours(200)))
    assert len(found) > 30 and set(found.values()) == {1}


def test_daily_frame_looks_an_offset_up_once(spark):
    found = lookups(features.daily_training_frame(days(spark, 60)))
    assert len(found) > 15 and set(found.values()) == {1}


def test_split_of_rows_that_keep_their_chunk(spark):
    """Rows were sent and sorted a second time for their positions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        daily = days(spark, 2500)
        plain = splits.chronological_split(features.daily_training_frame(daily).select("series_id", "date", "aqi_us_epa"), grid=DAILY_GRID)
        frame = features.daily_training_frame(daily, keep_chunks=True).select("series_id", "date", CHUNK, "aqi_us_epa")
        kept = splits.chronological_split(frame, grid=DAILY_GRID)
        assert kept.columns == plain.columns and sorted(kept.collect()) == sorted(plain.collect())
        assert frame.select(CHUNK).distinct().count() > 1
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (plain, kept)]
        assert plans[0].count("row_number()") == plans[1].count("row_number()")
        assert plans[1].count("Exchange hashpartitioning") < plans[0].count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_folds_store_the_columns_they_use(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(u, begin + timedelta(hours=7 * i), float(i % 9)) for u in (1, 2) for i in range(90)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    ).write.parquet(str(tmp_path / "events.parquet"))
    place = (spark.sparkContext.applicationId, str(tmp_path))
    folds = catalog.QUERIES["purged_cv_folds"](spark, str(tmp_path)).count()
    assert list(catalog.STORED[place]) == [("series_id", "time")]
    catalog.training(spark, str(tmp_path))
    assert catalog.QUERIES["purged_cv_folds"](spark, str(tmp_path)).count() == folds > 0
    assert catalog.training(spark, str(tmp_path)).columns == list(catalog.FRAME_COLUMNS)
    assert len(catalog.STORED[place]) == 2
