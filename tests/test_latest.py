from hazeline.operators.features import latest_window
from hazeline.sources import store


def test_latest_rows_of_a_stored_table(spark, hours, tmp_path):
    """Series that ended long ago or have gaps keep their last rows; years on both sides are skipped."""
    df = hours(24 * 500, start="2023-06-01", pm2_5=float)
    df = df.union(hours(300, start="2022-02-01", series="ended", pm2_5=float))
    df = df.union(hours(400, start="2024-01-20", series="gaps", skip=range(5, 390), pm2_5=float))
    root, as_of = str(tmp_path), "2024-02-20 10:20:00"
    store.write_feature_table(df, root, "hourly_raw", ["pm2_5"])
    for rows in (1, 24, 168):
        got = store.read_latest(spark, root, "hourly_raw", as_of, rows)
        expected = latest_window(df, as_of, rows)
        found = latest_window(got, as_of, rows)
        assert found.exceptAll(expected).count() == 0 and found.count() == expected.count()
        assert got.groupBy("series_id").count().agg({"count": "max"}).first()[0] <= rows + 23
    live = store.read_latest(spark, root, "hourly_raw", as_of, 24)
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "year#" in plan and ">= 2022" in plan and "<= 2024" in plan
    assert store.read_latest(spark, root, "hourly_raw", "2020-01-01 00:00:00", 24).count() == 0
