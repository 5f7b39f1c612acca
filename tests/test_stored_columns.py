"""What registered queries store and shuffle of the training frame."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from hazeline.operators import baselines, splits
from hazeline.plans import catalog
from hazeline.schema import HOURLY_AQI, TARGET_COLUMNS

Asked = type("Asked", (Exception,), {})


@pytest.mark.parametrize("name", ["evaluate_outputs", "rolling_origin_evaluation", "release_gate", "should_promote"])
def test_baselines_store_labels_and_the_index_alone(name, monkeypatch):
    import __spark_entry__ as entry

    def record(spark, sf_dir, columns=catalog.FRAME_COLUMNS):
        raise Asked(list(columns))

    monkeypatch.setattr(catalog, "training", record)
    for module in (catalog, entry.queries_products):
        monkeypatch.setattr(module, "shared_folder", lambda spark, purpose: "nowhere")
    with pytest.raises(Asked) as asked:
        entry.queries()[name](SimpleNamespace(conf=SimpleNamespace(set=lambda *option: None)), "none")
    assert asked.value.args[0] == ["series_id", "time", HOURLY_AQI, *TARGET_COLUMNS]


def test_folds_of_forecasts_share_the_exchange_of_their_windows(hours):
    frame = hours(400, start="2026-05-01", **{HOURLY_AQI: lambda i: 50 + i % 7})

    def folds(**more):
        return splits.rolling_origin_folds(baselines.seasonal_persistence_forecast(frame, **more), 2, 72)

    def wide(df) -> int:
        plan = df._jdf.queryExecution().executedPlan().toString()
        return sum("Exchange hashpartitioning(series_id" in line and "_chunk" in line for line in plan.splitlines())

    kept, apart = folds(keep_chunks=True), folds()
    assert kept.columns == apart.columns
    assert wide(kept) < wide(apart)
    assert sorted(kept.collect()) == sorted(apart.collect())
    whole = baselines.seasonal_persistence_forecast(frame, keep_chunks=True)
    assert sorted(splits.chronological_split(whole).collect()) == sorted(
        splits.chronological_split(baselines.seasonal_persistence_forecast(frame)).collect()
    )
