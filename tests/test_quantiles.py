import random

from pyspark.sql import functions as F

from hazeline.operators import quantiles
from hazeline.operators.quality import range_report
from hazeline.operators.quantiles import exact_quantiles, long_values, sketched

SHARES = [0.0, 0.25, 0.5, 0.9, 1.0]


def both(df, columns, shares=SHARES):
    values = long_values(df, columns)
    got = exact_quantiles(values, sketched(values), shares)
    told = {(r["series_id"], r["column"]): r["quantiles"] for r in got.collect()}
    plain = values.groupBy("series_id", "column").agg(F.percentile("_value", F.lit(shares)).alias("q"))
    return told, {(r["series_id"], r["column"]): r["q"] or [None] * len(shares) for r in plain.collect()}


def test_equal_to_percentile(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    monkeypatch.setattr(quantiles, "SKETCH", 64)
    draw = random.Random(5)
    rows = [("long", draw.gauss(0, 100), float(draw.randrange(3))) for _ in range(20_000)]
    rows += [("short", float(i), None) for i in range(4)] + [(None, 7.5, float("nan")), ("one", -1.0, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, smooth double, coarse double")
    told, expected = both(df, ["smooth", "coarse"])
    assert told == expected
    assert told["short", "coarse"] == [None] * 5


def test_sketch_that_misses(spark, monkeypatch):
    """A bracket far from the rank costs rounds, not the result."""
    monkeypatch.setattr(quantiles, "FEW", 5)
    real = quantiles._bracketed

    def wrong(targets):
        end = F.when(F.col("a").isNotNull(), F.lit(700.0) + F.col("rank") % 2)
        low = F.greatest(end, F.col("lo") + 1.0)
        moved = real(targets).withColumn("_m", F.when(F.col("n") > 800, low).otherwise(F.col("a")))
        return moved.withColumn("b", F.when(F.col("n") > 800, F.col("_m") + 1).otherwise(F.col("b"))).withColumn("a", F.col("_m")).drop("_m")

    monkeypatch.setattr(quantiles, "_bracketed", wrong)
    df = spark.range(1000).select(F.lit("a").alias("series_id"), F.col("id").cast("double").alias("v"))
    told, expected = both(df, ["v"], [0.1, 0.5, 0.7, 0.95])
    assert told == expected


def test_empty_and_report(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -2.0), ("a", None), ("b", None)], "series_id string, v double")
    told, expected = both(df.limit(0), ["v"])
    assert told == {} == expected
    got = {r["series_id"]: tuple(r)[1:] for r in range_report(df).collect()}
    assert got == {"a": ("v", 1, -2.0, -0.5, 1.0), "b": ("v", 0, None, None, None)}


def test_few_rows_need_no_sketch(spark, monkeypatch):
    """Short series are sorted; only those with more rows are sketched, and both give what percentile gives."""
    monkeypatch.setattr(quantiles, "FEW", 50)
    draw, sketches = random.Random(7), []
    real = quantiles.sketched
    monkeypatch.setattr(quantiles, "sketched", lambda values, **more: sketches.append(values) or real(values, **more))
    rows = [(f"s{i % 40}", draw.gauss(0, 9), float(draw.randrange(4)) if i % 3 else None) for i in range(1000)]
    rows += [(None, 1.5, -1.0), (None, 2.0, float("nan")), ("none", None, None)]
    short = spark.createDataFrame(rows, "series_id string, a double, b double")

    def check(df):
        plain = long_values(df, ["a", "b"]).groupBy("series_id", "column").agg(
            F.count_if(F.col("_value") < 0), F.min("_value"), F.percentile("_value", F.lit(0.5)), F.max("_value")
        )
        assert {tuple(r) for r in range_report(df).collect()} == {tuple(r) for r in plain.collect()}

    check(short)
    assert not sketches
    long = spark.createDataFrame([("long", draw.gauss(5, 2), float(i % 3)) for i in range(400)], short.schema)
    check(short.unionByName(long))
    assert [r[0] for r in sketches[0].select("series_id").distinct().collect()] == ["long"]
