from hazeline.sources import store


def test_batches_are_written_without_a_shuffle(spark, hours, tmp_path):
    """Whole rows stay with their tasks: a task writes a file for each year it holds, and nothing is shuffled."""
    df = hours(48, start="2023-12-31", pm2_5=float).union(hours(48, start="2023-12-31", series="b", pm2_5=float))
    tasks = df.rdd.getNumPartitions()
    store.write_feature_table(df, str(tmp_path), "hourly_raw", ["pm2_5"])
    files = [f.name for f in tmp_path.glob("hourly_raw/batch=*/year=*/*.parquet")]
    assert len(files) > 2 and len({f.split("-")[1] for f in files}) > 1 and len(files) <= 2 * tasks
    assert all(".zstd." in f for f in files)
    got = store.get_hourly_raw(spark, str(tmp_path))
    assert got.count() == 96 and got.exceptAll(df.select(got.columns)).count() == 0
