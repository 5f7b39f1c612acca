"""Rounding of query results."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hazeline.plans.catalog import rounded


def test_rounding_is_that_of_spark(spark):
    draw = random.Random(5)
    values = [0.0, -0.0, 1e-9, -1e-9, 5e-7, -5e-7, 1.5e-6, 0.0000025, 2.0000005, 1234.5678905, float("nan"), None]
    values += [float("inf"), float("-inf"), 1e15 + 0.3, 999999.9999995, -123456.7890125, 4.35, 1e300]
    values += [draw.uniform(-1, 1) * 10 ** draw.randint(-9, 14) for _ in range(3000)]
    values += [draw.randint(-(10**9), 10**9) / 2e6 for _ in range(1000)] + [draw.randint(-999, 999) / 1e6 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 6, 9):
        both = df.select(F.expr(f"hex(string({rounded('x', digits)}))").alias("a"), F.expr(f"hex(string(round(x, {digits})))").alias("b"))
        assert both.where("NOT a <=> b").count() == 0
