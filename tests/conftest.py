from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hazeline.schema import BASE_COLUMNS  # noqa: E402
from hazeline.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture(scope="session")
def hours(spark):
    """Build hourly rows: ``hours(n, start, **columns)`` with functions or constants."""

    def build(n, start="2026-01-01", series="a", skip=(), **columns):
        begin = datetime.fromisoformat(start)

        def value(source, i):
            found = source(i) if callable(source) else source
            return None if found is None else float(found)

        rows = [
            (series, begin + timedelta(hours=i), *[value(f, i) for f in columns.values()])
            for i in range(n)
            if i not in skip
        ]
        measures = ", ".join(f"{c} double" for c in columns)
        return spark.createDataFrame(rows, f"series_id string, time timestamp_ntz, {measures}")

    return build


@pytest.fixture(scope="session")
def full_hours(hours):
    """All 19 measures, 10 + i % 40."""

    def build(n, **kwargs):
        return hours(n, **kwargs, **{c: lambda i: 10.0 + i % 40 for c in BASE_COLUMNS})

    return build
