import random

from pyspark.sql import functions as F

from hazeline.functions.aqi import HIGH_AQI, band_sql
from hazeline.operators import evaluation
from hazeline.schema import HOURLY_AQI, TARGET_COLUMNS

PLAIN = {
    "mse": "avg((yhat - y) * (yhat - y)) * count((yhat - y)) / count(1)",
    "mae": "sum(abs(yhat - y)) / count(1)",
    "r2": "CASE WHEN min(y) <> max(y) THEN 1 - try_divide(sum((yhat - y) * (yhat - y)), var_pop(y) * count(y)) "
    "WHEN sum((yhat - y) * (yhat - y)) = 0 THEN 1 ELSE 0 END",
    "category_accuracy": f"count_if({band_sql('y')} <=> {band_sql('yhat')}) / count(1)",
    "high_aqi_recall": f"coalesce(try_divide(double(count_if(y >= {HIGH_AQI} AND yhat >= {HIGH_AQI})), "
    f"count_if(y >= {HIGH_AQI})), 0D)",
}


def forecasts(spark, odd):
    """Labels with nulls and whatever ``odd`` lists, equal keys and a null key, in several partitions."""
    random.seed(5)
    values = [0.0, 49.5, 50.5, 100.5, 101.0, 150.4, 250.0, 300.0, 501.0, *odd]
    rows = []
    for _ in range(400):
        labels = [random.choice(values) for _ in TARGET_COLUMNS]
        rows.append([random.choice(["a", "b", None]), random.choice([7.0, *values]), *labels])
    rows += [["none", 5.0, *[None] * 30], ["same", 5.0, *[5.0] * 30], ["same", 5.0, *[5.0] * 30]]
    names = ", ".join(f"{t} double" for t in TARGET_COLUMNS)
    df = spark.createDataFrame(rows, f"series_id string, {HOURLY_AQI} double, {names}").repartition(5)
    return df.withColumns({f"m__{t}": F.col(HOURLY_AQI) + i for i, t in enumerate(TARGET_COLUMNS)})


def by_key(df):
    key = lambda r: (r["series_id"] or "", r["output_index"])
    return {key(r): [None if r[m] is None else round(r[m], 9) for m in PLAIN] for r in df.collect()}


def plain(df):
    long = evaluation.to_long(df, ["m"])
    return by_key(long.groupBy("series_id", "model", "output_index").agg(*[F.expr(f"{s} AS {m}") for m, s in PLAIN.items()]))


def test_cells_have_the_metrics_of_single_rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for odd in ([None], [None, -3.0, float("nan")]):
            df = forecasts(spark, odd)
            stats = lambda rows: evaluation._statistics_by(rows, ("series_id", "model", "output_index"))
            finish = lambda s: by_key(evaluation._finish(s, ("series_id", "model", "output_index"), evaluation.ALL_SQL))
            want = plain(df)
            assert len(want) == 150
            got, long = finish(stats(evaluation.to_cells(df, ["m"]))), finish(stats(evaluation.to_long(df, ["m"])))
            assert str(got) and {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}
            assert {k: str(v) for k, v in long.items()} == {k: str(v) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_of_several_frames(spark):
    df = forecasts(spark, [None])
    both = df.withColumns({f"n__{t}": F.col(t) for t in TARGET_COLUMNS})
    together = evaluation.evaluate_outputs(evaluation.to_cells(both, ["m", "n"]))
    apart = evaluation.evaluate_outputs([evaluation.to_cells(df, ["m"]), evaluation.to_long(both, ["n"])])
    shown = lambda d: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.collect())
    assert shown(together) == shown(apart)


def test_cells_are_not_unfolded(spark):
    """A row per model, not one per model and output, reaches the tasks that form statistics."""
    cells = evaluation.to_cells(forecasts(spark, []), ["m"])
    assert cells.count() == 403
    plan = evaluation.regression_metrics(cells)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan
