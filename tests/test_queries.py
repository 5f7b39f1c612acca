from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, canonical

DATA = Path("/root/testdata/sf0.001")
QUICK = ["validate_hourly_cadence", "missing_hours", "annual_weather", "high_water_mark", "daily_aqi"]


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = canonical(entry.queries()[name](spark, str(DATA)).toPandas())
    assert got.equals(canonical(con.execute(entry.oracle_sql()[name]).df()))
