from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hazeline.operators import products
from hazeline.operators.features import hourly_training_frame
from hazeline.schema import AIR_SCHEMA, hourly_feature_columns
from hazeline.sources import raw, responses, store
from hazeline.streaming.refresh import start_feature_stream


def test_forecast_labels(spark):
    def vector(n):
        rows = [("a", datetime(2026, 8, 13), [float(i) for i in range(n)])]
        return spark.createDataFrame(rows, "series_id string, time timestamp_ntz, forecast array<double>")

    got = products.forecast_rows(vector(30), vector="forecast").orderBy("value").collect()
    kinds = [r["kind"] for r in got]
    assert (kinds.count("point"), kinds.count("six_hour_mean"), kinds.count("twelve_hour_mean")) == (24, 4, 2)
    assert got[0]["start_time"] == got[0]["end_time"] == datetime(2026, 8, 13, 1)
    assert got[-1]["end_time"] == datetime(2026, 8, 16)
    with pytest.raises(Exception, match="expected 30"):
        products.forecast_rows(vector(29), vector="forecast").collect()


def test_reference_range_is_half_open(spark, hours):
    ref = hours(100, aqi=float)
    origins = spark.createDataFrame(
        [("a", datetime(2026, 1, 1, 5))], "series_id string, forecast_origin timestamp_ntz"
    )
    got = products.trim_reference(ref, origins).agg(F.min("aqi"), F.max("aqi"), F.count("*")).first()
    assert tuple(got) == (5, 76, 72)
    trimmed = products.trim_reference(ref, origins)
    assert products.reference_now(trimmed, "2026-01-01 08:30:00").first()["ref_now"] == 8
    assert products.reference_now(trimmed, "2027-01-01").first()["ref_now"] == 5


def test_forecast_response_keeps_pairs(spark, tmp_path):
    text = '{"series_id": "a", "timezone": "Asia/Karachi", "hourly": {"time": ["2026-08-16T17:00", "2026-08-16T18:00", "2026-08-16T19:00"], "us_aqi": [113, null, 115]}}'
    (tmp_path / "r.json").write_text(text)
    landed = responses.read_responses(spark, str(tmp_path), "hourly", ["us_aqi"])
    rows = responses.forecast_response_to_rows(landed).orderBy("time").collect()
    assert [(r["time"].hour, r["aqi"]) for r in rows] == [(17, 113), (19, 115)]
    (tmp_path / "r.json").write_text('{"series_id": "a", "error": true}')
    broken = responses.read_responses(spark, str(tmp_path), "hourly", ["us_aqi"])
    with pytest.raises(Exception, match="lacks hourly times"):
        responses.forecast_response_to_rows(broken).collect()


def test_raw_folder(spark, tmp_path, hours):
    with pytest.raises(FileNotFoundError):
        raw.read_raw(spark, str(tmp_path / "none"), AIR_SCHEMA, "aqi_training")
    with pytest.raises(ValueError):
        raw.write_raw(hours(1, pm10=1.0), str(tmp_path), "p", "other", "hourly", "a", "b", "c")
    with pytest.raises(ValueError):
        raw.append_new_rows(hours(1, pm10=1.0), hours(1, pm10=2.0), policy="mixed")


def test_backfill_round_trip(spark, tmp_path, full_hours):
    root, df = str(tmp_path), full_hours(200)
    for _ in range(2):
        store.backfill_hourly(spark, df, root, replace=True)
    built = hourly_training_frame(df, include_targets=False)
    stored = store.get_hourly_observations(spark, root)
    assert stored.columns == built.columns and stored.count() == built.count()
    assert built.exceptAll(stored).count() == 0
    contract = hourly_feature_columns(df.columns)
    store.validate_feature_schema(spark, root, "hourly_observations", contract)
    with pytest.raises(ValueError, match="missing=\\['new'\\] extra=\\[\\]"):
        store.validate_feature_schema(spark, root, "hourly_observations", [*contract, "new"])
    with pytest.raises(ValueError, match="no metadata"):
        store.validate_feature_schema(spark, root, "daily_features", contract)
    part = store.get_hourly_raw(spark, root, "2026-01-02 00:00:00", "2026-01-02 05:00:00")
    assert part.count() == 6
    assert [r["table_name"] for r in store.table_stats(spark, root).collect()] == [
        "hourly_features", "hourly_observations", "hourly_raw",
    ]


def test_stream_equals_rebuild(spark, tmp_path, full_hours):
    df = full_hours(240)
    landing, root, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    cut = F.lit("2026-01-06").cast("timestamp_ntz")
    for part in (df.where(F.col("time") < cut), df.where(F.col("time") >= cut)):
        part.write.mode("append").parquet(landing)
        start_feature_stream(spark, landing, root, mark, df.schema).awaitTermination()
    for stored, built in (
        (store.get_hourly_features(spark, root), hourly_training_frame(df)),
        (store.get_hourly_observations(spark, root), hourly_training_frame(df, False)),
    ):
        assert built.exceptAll(stored).count() == 0 and stored.count() == built.count()
