import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hazeline.operators import quality
from hazeline.operators.chunks import DAILY_GRID


@pytest.fixture(scope="module")
def scattered(spark):
    """Series before and after 1970 with gaps of years, repeats, times off the hour and missing times."""
    draw = random.Random(3)
    rows = []
    for series, start in (("old", datetime(1958, 3, 1)), ("new", datetime(2020, 1, 1)), (None, datetime(1969, 12, 30))):
        kept = [i for i in range(600) if draw.random() > 0.1] + [100_000, 100_001]
        rows += [(series, start + timedelta(hours=i)) for i in kept for _ in range(1 + (i % 50 == 0))]
    rows += [("off", datetime(2020, 1, 1, h, m)) for h in range(5) for m in (10, 40)] + [("off", None), ("none", None)]
    return spark.createDataFrame(rows, "series_id string, time timestamp_ntz")


def test_report(scattered):
    plain = scattered.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("time").alias("distinct_steps"),
        F.count_if(F.col("time").isNull()).alias("invalid"),
    )
    report = quality.validate_hourly_cadence(scattered)
    assert sorted(map(str, report.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    told = {r["series_id"]: r for r in report.collect()}
    assert (told["off"]["aligned"], told["new"]["aligned"], told["none"]["expected_steps"]) == (False, True, None)
    assert told["old"]["expected_steps"] == 100_002 and not told["old"]["complete"]


def test_missing_steps(scattered):
    rows = scattered.where("time IS NOT NULL AND NOT series_id <=> 'off'").collect()
    held = {}
    for r in rows:
        held.setdefault(r["series_id"], set()).add(r["time"])
    expected = set()
    for series, times in held.items():
        at = min(times)
        while at < max(times):
            if at not in times:
                expected.add((series, at))
            at += timedelta(hours=1)
    got = quality.missing_steps(scattered.where("NOT series_id <=> 'off'")).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_missing_days(spark):
    days = spark.sql("SELECT 'a' AS series_id, date_add(DATE'1969-12-28', int(id)) AS date FROM range(10) WHERE id NOT IN (3, 7)")
    got = quality.missing_steps(days, DAILY_GRID).orderBy("date").collect()
    assert [str(r["date"]) for r in got] == ["1969-12-31", "1970-01-04"]
    assert quality.validate_daily_cadence(days).first()["missing_steps"] == 2


def test_one_aggregate_a_product(spark, full_hours):
    df = full_hours(48).withColumn("source", F.lit("open_meteo_x"))
    plan = quality.qc_summary(df, df, "2026-01-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("bitmap_construct_agg") == 4  # partial and final, of two products
