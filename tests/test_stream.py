"""The stream on batches as they come: short, repeated, young, late."""

from __future__ import annotations

from hazeline.operators.features import hourly_training_frame
from hazeline.operators.summary import daily_features
from hazeline.schema import TIME
from hazeline.sources import store
from hazeline.streaming.refresh import DAILY_TABLE, refresh


def same(stored, built):
    built = built.select(*stored.columns)
    return built.exceptAll(stored).count() == 0 and stored.count() == built.count()


def test_batches_that_end_inside_days(spark, tmp_path, full_hours):
    root = str(tmp_path / "store")
    good, late = full_hours(150), full_hours(150, series="b", skip=range(30, 32))

    def part(df, low, high):
        return df.where(f"{TIME} >= timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, 0, {low}) AND {TIME} < timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, 0, {high})")

    both = good.unionByName(late)
    arrivals = [part(both, 0, 76), part(both, 76, 77), part(both, 76, 77), part(both, 77, 143)]
    for i, rows in enumerate(arrivals):
        refresh(rows, i, root)
    first = part(good, 0, 143)
    assert same(store.get_hourly_features(spark, root), hourly_training_frame(first))
    assert same(store.get_hourly_observations(spark, root), hourly_training_frame(first, False))
    days = daily_features(first).where("hour_count = 24")
    assert same(store.read_feature_table(spark, root, DAILY_TABLE), days)
    # The missing hours arrive: the series catches up. Then the last hours, the last batch twice.
    mended = full_hours(150, series="b")
    refresh(part(mended, 30, 32), 4, root)
    for _ in range(2):
        refresh(part(good.unionByName(mended), 143, 150), 5, root)
    whole = good.unionByName(mended)
    assert same(store.get_hourly_features(spark, root), hourly_training_frame(whole))
    assert same(store.get_hourly_observations(spark, root), hourly_training_frame(whole, False))
    days = daily_features(whole).where("hour_count = 24")
    assert same(store.read_feature_table(spark, root, DAILY_TABLE), days)
    rows = {r["table_name"]: r["n_rows"] for r in store._meta(spark, root).collect()}
    assert rows["hourly_raw"] == 300
