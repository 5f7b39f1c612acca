"""Registered queries: responses, raw tables, store and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators import aqi, quality
from hazeline.plans import oracle as sql
from hazeline.plans import testbed as data
from hazeline.plans.catalog import FEATURE_FLOATS, query
from hazeline.schema import (
    AIR_COLUMNS,
    AIR_SCHEMA,
    BASE_COLUMNS,
    DATE,
    KEYS,
    LOCAL_ZONE,
    TARGET_COLUMNS,
    TIME,
    TREND_COLUMNS,
    TREND_SOURCE,
    WEATHER_COLUMNS,
    hourly_feature_columns,
    hourly_schema,
)
from hazeline.session import shared_folder
from hazeline.sources import raw as raw_tables
from hazeline.sources import responses, store
from hazeline.streaming.refresh import DAILY_TABLE, start_feature_stream

SPLIT_DAY = "2024-01-20"
OVERLAP_DAY = "2024-01-17"


def as_responses(df: DataFrame, variables, block: str, part, keys=KEYS, when=TIME) -> DataFrame:
    """Rows as landed responses: one JSON text per series and ``part`` (a day or a year)."""
    clock = "yyyy-MM-dd" if block == "daily" else "yyyy-MM-dd'T'HH:mm"
    row = F.struct(when, *variables)
    grouped = df.groupBy(*keys, part.alias("_part")).agg(
        F.sort_array(F.collect_list(row)).alias("r")
    )
    arrays = F.struct(
        F.transform(f"r.{when}", lambda t: F.date_format(t, clock)).alias("time"),
        *[F.col(f"r.{v}").alias(v) for v in variables],
    )
    body = F.struct(*keys, F.lit(LOCAL_ZONE).alias("timezone"), arrays.alias(block))
    return grouped.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def parsed(texts: DataFrame, block: str, variables, keys=KEYS) -> DataFrame:
    schema = responses.response_schema(block, variables, keys)
    return texts.select(F.from_json("value", schema).alias("d")).select("d.*")


@query("hourly_response_to_rows", sql.shaped("SELECT * FROM air", floats=AIR_COLUMNS))
def hourly_response_to_rows(spark, sf_dir):
    """Through response files of one day each, written and read back."""
    texts = as_responses(
        data.air_hourly(spark, sf_dir), AIR_COLUMNS, "hourly", F.to_date(TIME)
    )
    folder = shared_folder(spark, "responses")
    texts.select("value").write.text(folder)
    landed = responses.read_responses(spark, folder, "hourly", AIR_COLUMNS)
    return responses.product_rows(landed, "air")


@query(
    "daily_response_to_rows",
    sql.shaped(
        f"SELECT *, '{TREND_SOURCE}' AS source FROM trend", floats=TREND_COLUMNS, days=["date"]
    ),
)
def daily_response_to_rows(spark, sf_dir):
    trend = data.weather_trend_daily(spark, sf_dir)
    texts = as_responses(trend, TREND_COLUMNS, "daily", F.year(DATE), when=DATE)
    return responses.product_rows(parsed(texts, "daily", TREND_COLUMNS), "trend")


@query(
    "forecast_response_to_rows",
    sql.shaped(
        "SELECT series_id, time, aqi_pm2_5 AS aqi FROM subs WHERE aqi_pm2_5 IS NOT NULL",
        floats=["aqi"],
    ),
)
def forecast_response_to_rows(spark, sf_dir):
    """The first hours of every series have no value and must not shift the others."""
    rows = aqi.hourly_subindices(data.hourly_master(spark, sf_dir)).select(
        *KEYS, TIME, F.col("aqi_pm2_5").alias("us_aqi")
    )
    texts = as_responses(rows, ["us_aqi"], "hourly", F.to_date(TIME))
    return responses.forecast_response_to_rows(parsed(texts, "hourly", ["us_aqi"]))


@query(
    "live_check",
    sql.statement(
        "SELECT series_id, strftime(time, '%Y-%m-%d') AS day, "
        "CASE WHEN bool_and(aqi_pm2_5 IS NOT NULL) THEN 'PASS' ELSE 'REVIEW' END AS verdict "
        "FROM subs GROUP BY 1, 2"
    ),
)
def live_check(spark, sf_dir):
    """Per series and day; the first day lacks values of the averaged index."""
    keys = (*KEYS, "day")
    day = F.date_format(TIME, "yyyy-MM-dd").alias("day")
    air = aqi.hourly_subindices(data.hourly_master(spark, sf_dir)).select(
        *KEYS, day, TIME, F.col("aqi_pm2_5").alias("us_aqi")
    )
    weather = data.weather_hourly(spark, sf_dir).select("*", day)
    checked = []
    for rows, variables in ((air, ["us_aqi"]), (weather, list(WEATHER_COLUMNS))):
        texts = as_responses(rows, variables, "hourly", F.lit(0), keys)
        landed = parsed(texts, "hourly", variables, keys)
        checked.append(responses.response_values(landed, "hourly", variables, keys))
    return quality.live_check(*checked, LOCAL_ZONE, keys)


def before(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col(TIME) < F.lit(day).cast("timestamp_ntz"))


def since(df: DataFrame, day: str) -> DataFrame:
    return df.where(F.col(TIME) >= F.lit(day).cast("timestamp_ntz"))


def overlapping(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two pulls that share three days; the later one has other PM2.5 values."""
    air = data.air_hourly(spark, sf_dir)
    later = since(air, OVERLAP_DAY).withColumn("pm2_5", F.col("pm2_5") + 1000)
    return before(air, SPLIT_DAY), later


FIRST_WINS = (
    f"SELECT * REPLACE (CASE WHEN time < TIMESTAMP '{SPLIT_DAY}' THEN pm2_5 ELSE pm2_5 + 1000 END "
    "AS pm2_5) FROM air"
)
LAST_WINS = FIRST_WINS.replace(SPLIT_DAY, OVERLAP_DAY)


@query(
    "raw_round_trip",
    sql.shaped(FIRST_WINS, floats=AIR_COLUMNS),
)
def raw_round_trip(spark, sf_dir):
    """Two landed pulls, read back with the earlier one winning."""
    root = shared_folder(spark, "raw")
    first, second = overlapping(spark, sf_dir)
    pulls = ((first, "2024-01-01", SPLIT_DAY), (second, OVERLAP_DAY, "2024-01-30"))
    for rows, start, end in pulls:
        raw_tables.write_raw(rows, root, "aqi_training", "open_meteo", "hourly", start, end, end)
    return raw_tables.read_raw(spark, root, AIR_SCHEMA, "aqi_training").drop("requested_end")


@query("raw_csv", sql.shaped("SELECT * FROM air", floats=AIR_COLUMNS))
def raw_csv(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    data.air_hourly(spark, sf_dir).write.option("header", True).csv(folder)
    return raw_tables.read_raw_csv(spark, folder, AIR_SCHEMA)


@query("append_new_rows", sql.shaped(FIRST_WINS, floats=AIR_COLUMNS))
def append_new_rows(spark, sf_dir):
    return raw_tables.append_new_rows(*overlapping(spark, sf_dir))


@query("append_latest_wins", sql.shaped(LAST_WINS, floats=AIR_COLUMNS))
def append_latest_wins(spark, sf_dir):
    return raw_tables.append_new_rows(*overlapping(spark, sf_dir), policy="latest_wins")


@query(
    "high_water_mark",
    sql.statement("SELECT series_id, max(time) AS latest FROM hours GROUP BY series_id"),
)
def high_water_mark(spark, sf_dir):
    return raw_tables.high_water_mark(data.event_hours(spark, sf_dir))


STARTS = {"air": "2024-01-01", "weather": "2024-01-01", "trend": "2023-12-25"}
PULL_END = "2024-01-30"


@query(
    "incremental_range",
    sql.shaped(
        f"""
WITH w AS (
  SELECT 'u' || user_id AS series_id,
         CAST(max(ts) FILTER (event_type IN ('click', 'signup')) AS DATE) AS air,
         CAST(max(ts) FILTER (event_type IN ('view', 'purchase')) AS DATE) AS weather,
         CAST(max(ts) FILTER (event_type = 'error') AS DATE) AS trend
  FROM events GROUP BY 1),
b AS (
  SELECT series_id, air IS NULL OR weather IS NULL AS restart,
         CASE WHEN air IS NULL OR weather IS NULL THEN DATE '2024-01-01' ELSE air + 1 END AS air,
         CASE WHEN air IS NULL OR weather IS NULL THEN DATE '2024-01-01' ELSE weather + 1 END AS weather,
         CASE WHEN air IS NULL OR weather IS NULL OR trend IS NULL THEN DATE '2023-12-25'
              ELSE trend + 1 END AS trend FROM w),
p AS (
  SELECT series_id, 'air' AS product, air AS start, * EXCLUDE (series_id) FROM b
  UNION ALL SELECT series_id, 'weather', weather, * EXCLUDE (series_id) FROM b
  UNION ALL SELECT series_id, 'trend', trend, * EXCLUDE (series_id) FROM b)
SELECT series_id, product, CAST(unnest(generate_series(CAST(start AS TIMESTAMP),
       TIMESTAMP '{PULL_END}', INTERVAL 1 DAY)) AS DATE) AS date
FROM p WHERE restart OR NOT (air > DATE '{PULL_END}' AND weather > DATE '{PULL_END}')""",
        days=["date"],
    ),
)
def incremental_range(spark, sf_dir):
    """Clicks and signups stand for landed air, views and purchases for weather, errors for trend data."""
    product = F.expr(
        "CASE WHEN event_type IN ('click', 'signup') THEN 'air' "
        "WHEN event_type IN ('view', 'purchase') THEN 'weather' WHEN event_type = 'error' THEN 'trend' END"
    )
    marks = (
        data.table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("series_id"), product.alias("product"))
        .agg(F.max("ts").alias("latest"))
    )
    return raw_tables.incremental_range(marks, STARTS, PULL_END)


# ---- store ---------------------------------------------------------------------------------

SLICE = ("2024-01-10 00:00:00", "2024-01-12 23:00:00")


@query(
    "read_feature_table",
    sql.shaped(
        f"SELECT series_id, time, {sql.columns(AIR_COLUMNS)} FROM air "
        f"WHERE time BETWEEN TIMESTAMP '{SLICE[0]}' AND TIMESTAMP '{SLICE[1]}'",
        floats=AIR_COLUMNS,
    ),
)
def read_feature_table(spark, sf_dir):
    """A table written, appended to and read back in a time slice."""
    root = shared_folder(spark, "store")
    air = data.air_hourly(spark, sf_dir).drop("source")
    day = "2024-01-11"
    store.write_feature_table(before(air, day), root, "hourly_raw", AIR_COLUMNS)
    store.write_feature_table(since(air, day), root, "hourly_raw", AIR_COLUMNS, replace=False)
    return store.get_hourly_raw(spark, root, *SLICE)


BACKFILLED: dict[tuple[str, str], str] = {}


def backfilled(spark, sf_dir) -> str:
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in BACKFILLED:
        root = shared_folder(spark, "store")
        store.backfill_hourly(spark, data.hourly_master(spark, sf_dir), root, source="events")
        store.backfill_daily(spark, data.daily_series(spark, sf_dir), root, source="lineitem")
        BACKFILLED[place] = root
    return BACKFILLED[place]


N_FEATURES = len(hourly_feature_columns(BASE_COLUMNS))


@query(
    "table_stats",
    sql.shaped(
        f"""
SELECT 'hourly_raw' AS table_name, 1 AS schema_version, {len(BASE_COLUMNS)} AS features, 0 AS targets,
       count(*) AS n_rows, 'events' AS source_file FROM master
UNION ALL SELECT 'hourly_observations', 1, {N_FEATURES}, 0, count(*), 'events' FROM observations
UNION ALL SELECT 'hourly_features', 1, {N_FEATURES}, 30, count(*), 'events' FROM training
UNION ALL SELECT 'daily_features', 1, {len(sql.DAILY_FEATURES)}, 3, count(*), 'lineitem' FROM daily_training""",
        whole=["schema_version", "features", "targets"],
    ),
)
def table_stats(spark, sf_dir):
    stats = store.table_stats(spark, backfilled(spark, sf_dir))
    return stats.select(
        "table_name",
        "schema_version",
        F.size("feature_columns").alias("features"),
        F.size("target_columns").alias("targets"),
        "n_rows",
        "source_file",
    )


@query(
    "backfill",
    sql.shaped("SELECT * FROM training", floats=[*FEATURE_FLOATS, *TARGET_COLUMNS]),
)
def backfill(spark, sf_dir):
    root = backfilled(spark, sf_dir)
    store.validate_feature_schema(
        spark, root, "hourly_observations", hourly_feature_columns(BASE_COLUMNS)
    )
    return store.get_hourly_features(spark, root)


@query(
    "export_table",
    sql.shaped(
        f"SELECT series_id, time, {sql.columns(BASE_COLUMNS)} FROM master "
        f"WHERE time BETWEEN TIMESTAMP '{SLICE[0]}' AND TIMESTAMP '{SLICE[1]}'",
        floats=BASE_COLUMNS,
    ),
)
def export_table(spark, sf_dir):
    folder = shared_folder(spark, "export")
    store.export_table(data.hourly_master(spark, sf_dir), folder, *SLICE)
    schema = hourly_schema(BASE_COLUMNS)
    schema = type(schema)([f for f in schema.fields if f.name != "source"])
    return raw_tables.read_raw_csv(spark, folder, schema)


# ---- stream ---------------------------------------------------------------------------------

STREAMED: dict[tuple[str, str], str] = {}


def streamed(spark, sf_dir) -> str:
    """Two arrivals that share three days, each taken in by its own run of the stream."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in STREAMED:
        landing, root, checkpoint = (
            shared_folder(spark, name) for name in ("landing", "store", "checkpoint")
        )
        master = data.hourly_master(spark, sf_dir)
        for rows in (before(master, SPLIT_DAY), since(master, OVERLAP_DAY)):
            rows.write.mode("append").parquet(landing)
            start_feature_stream(spark, landing, root, checkpoint, master.schema).awaitTermination()
        STREAMED[place] = root
    return STREAMED[place]


@query(
    "feature_stream",
    sql.shaped("SELECT * FROM training", floats=[*FEATURE_FLOATS, *TARGET_COLUMNS]),
)
def feature_stream(spark, sf_dir):
    return store.get_hourly_features(spark, streamed(spark, sf_dir))


@query(
    "feature_stream_daily",
    sql.shaped(
        "SELECT * FROM dfeat", floats=[*BASE_COLUMNS, *sql.SUBS, "aqi_us_epa"], days=["date"]
    ),
)
def feature_stream_daily(spark, sf_dir):
    return store.read_feature_table(spark, streamed(spark, sf_dir), DAILY_TABLE)


