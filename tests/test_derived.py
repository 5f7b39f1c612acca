"""Steps filled in for derived series, and daily rolling columns."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from hazeline.operators.chunks import DAILY_GRID, HOURLY_GRID, cut
from hazeline.operators.features import daily_lag_roll_columns
from hazeline.plans import testbed
from hazeline.schema import DATE, TIME


def test_steps_are_filled_in_by_all_tasks(spark):
    """Few series with many steps were unfolded in one task."""
    rows = [("a", datetime(2024, 1, 1), 5), ("b", datetime(2024, 2, 9, 23), 7), ("b", None, 9), (None, datetime(2024, 1, 3, 4), 1)]
    found = spark.createDataFrame(rows, f"series_id string, {TIME} timestamp_ntz, s bigint")
    filled = testbed.on_every_step(found, HOURLY_GRID, 24, ["s"])
    assert filled.select(F.spark_partition_id()).distinct().count() > 1
    steps = 40 * 24
    held = {r["series_id"]: (r["n"], r["s"], r["d"], r["t"]) for r in filled.groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum("s").alias("s"), F.count_distinct(TIME).alias("d"), F.max(F.when(F.col("s") == 5, F.col(TIME))).alias("t")
    ).collect()}
    assert held["a"] == (steps, 5, steps, datetime(2024, 1, 1))
    assert held["b"][:3] == (steps + 1, 16, steps)
    assert held[None][:3] == (steps, 1, steps)


def test_daily_rolls_by_offsets(spark):
    draw = random.Random(3)
    rows = [("a", date(2024, 1, 1) + timedelta(days=i), draw.uniform(0, 300), None if i == 20 else draw.uniform(0, 99)) for i in range(40)]
    df = spark.createDataFrame(rows, f"series_id string, {DATE} date, aqi_us_epa double, pm2_5 double")
    chunked = cut(df, DAILY_GRID, back=7)
    added = chunked.then(lambda c: c.df.withColumns(daily_lag_roll_columns(c))).result()
    frame = "OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    for k in (3, 7):
        over = frame.format(k - 1)
        for name, call, c in (("mean", "avg", "aqi_us_epa"), ("mean", "avg", "pm2_5"), ("std", "stddev_samp", "aqi_us_epa")):
            added = added.withColumn("_e", F.expr(f"CASE WHEN count({c}) {over} = {k} THEN {call}({c}) {over} END"))
            differ = f"NOT (round({c}_roll_{name}{k}, 9) <=> round(_e, 9))"
            assert added.where(differ).count() == 0
            assert added.where("_e IS NOT NULL").count() > 20
    plan = chunked.then(lambda c: c.df.withColumns(daily_lag_roll_columns(c))).df
    assert "stddev" not in plan._jdf.queryExecution().optimizedPlan().toString()
