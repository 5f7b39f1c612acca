"""Registered queries: every operator over tables derived from the driver's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions.aqi import epa_truncate, to_epa_units, UNIT_FACTORS
from hazeline.functions.calendar import (
    add_daily_calendar,
    add_hour_month_cycles,
    add_hourly_calendar,
    localise_time,
)
from hazeline.functions.common import double
from hazeline.operators import aqi, baselines, evaluation, features, merge, quality, splits, summary
from hazeline.operators.chunks import CHUNK, DAILY_GRID, HOURLY_GRID
from hazeline.plans import oracle as sql
from hazeline.plans import testbed as data
from hazeline.schema import (
    AIR_COLUMNS,
    BASE_COLUMNS,
    DAILY_AQI,
    DAILY_CALENDAR_COLUMNS,
    DATE,
    HOURLY_AQI,
    HOURLY_CALENDAR_COLUMNS,
    TARGET_COLUMNS,
    TEMPORAL_COLUMNS,
    TIME,
    TREND_COLUMNS,
    hourly_feature_columns,
)
from hazeline.session import configure, shared_folder
from hazeline.sources.store import COMPRESSION

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SERIES_TIME = ["series_id", TIME]
AS_OF = "2024-01-20 12:30:00"
TREND_YEAR = 2001


def rounded(value: str, digits: int) -> str:
    """``round(value, digits)`` of a double, the same number at a fraction of the time.

    Spark rounds by way of decimal text. Away from ties and from large numbers the nearest whole multiple is the
    same, and the quotient of two whole numbers is the double nearest to it; all others are left to ``round``.
    """
    scale = double(10**digits)
    units = f"{value} * {scale}"
    plain = f"abs({units}) < 1e12D AND abs({units} - rint({units})) < 0.499D"
    # Adding zero turns a negative zero into zero.
    return f"CASE WHEN {plain} THEN rint({units}) / {scale} + 0D ELSE round({value}, {digits}) END"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats to a fixed number of decimals, whole numbers as BIGINT and dates as text."""

    def shape(field):
        c = f"`{field.name}`"
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c if isinstance(field.dataType, T.DoubleType) else f"double({c})", digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = f"bigint({c})"
        elif isinstance(field.dataType, T.DateType):
            c = f"string({c})"
        return f"{c} AS `{field.name}`"

    return df.selectExpr(*[shape(f) for f in df.schema.fields])


def query(name: str, oracle: str | None = None, digits: int = 6):
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(build(configure(spark), sf_dir), digits)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


# ---- joins, calendar, units ---------------------------------------------------


@query(
    "merge_air_weather",
    sql.shaped(
        "SELECT a.* EXCLUDE (source), w.* EXCLUDE (series_id, time, source) "
        "FROM air a JOIN weather w ON w.series_id = a.series_id AND w.time = a.time",
        floats=BASE_COLUMNS,
    ),
)
def merge_air_weather(spark, sf_dir):
    return merge.merge_air_weather(data.air_hourly(spark, sf_dir), data.weather_hourly(spark, sf_dir))


HOUR_MONTH = ["hour_sin", "hour_cos", "month_sin", "month_cos"]


@query(
    "hour_month_cycles",
    sql.shaped(
        "SELECT series_id, time, pm2_5, "
        + ", ".join(f"{sql.HOURLY_CALENDAR[c]} AS {c}" for c in HOUR_MONTH)
        + " FROM master",
        floats=["pm2_5", *HOUR_MONTH],
    ),
)
def hour_month_cycles(spark, sf_dir):
    return add_hour_month_cycles(data.hourly_master(spark, sf_dir)).select(
        *SERIES_TIME, "pm2_5", *HOUR_MONTH
    )


@query(
    "hourly_calendar",
    sql.shaped(
        f"SELECT series_id, time, {sql.named(sql.HOURLY_CALENDAR)} FROM master",
        floats=[c for c in HOURLY_CALENDAR_COLUMNS if c != "is_weekend"],
    ),
)
def hourly_calendar(spark, sf_dir):
    return add_hourly_calendar(data.hourly_master(spark, sf_dir)).select(
        *SERIES_TIME, *HOURLY_CALENDAR_COLUMNS
    )


@query(
    "daily_calendar",
    sql.shaped(
        f"SELECT series_id, date, {sql.named(sql.DAILY_CALENDAR)} FROM daily_series",
        floats=[c for c in DAILY_CALENDAR_COLUMNS if c.endswith(("sin", "cos"))],
        days=["date"],
    ),
)
def daily_calendar(spark, sf_dir):
    return add_daily_calendar(data.daily_series(spark, sf_dir)).select(
        "series_id", DATE, *DAILY_CALENDAR_COLUMNS
    )


@query(
    "localise_time",
    "SELECT event_id, ts + INTERVAL 5 HOUR AS time FROM events",
)
def localised(spark, sf_dir):
    events = data.table(spark, sf_dir, "events").select("event_id", F.col("ts").alias(TIME))
    return localise_time(events)


@query(
    "epa_units",
    sql.shaped(
        "SELECT series_id, time, "
        + ", ".join(f"{p} * {sql.factor(p)} AS {p}" for p in UNIT_FACTORS)
        + ", floor(pm2_5 * 1e1) / 1e1 AS pm2_5 FROM master",
        floats=[*UNIT_FACTORS, "pm2_5"],
        digits=9,
    ),
    digits=9,
)
def epa_units(spark, sf_dir):
    return data.hourly_master(spark, sf_dir).select(
        *SERIES_TIME,
        *[to_epa_units(p, p).alias(p) for p in UNIT_FACTORS],
        epa_truncate("pm2_5", 1).alias("pm2_5"),
    )


# ---- AQI ------------------------------------------------------------------------


@query("hourly_subindices", sql.shaped("SELECT * FROM subs", floats=sql.SUBS))
def hourly_subindices(spark, sf_dir):
    return aqi.hourly_subindices(data.hourly_master(spark, sf_dir))


@query(
    "hourly_aqi",
    sql.shaped(
        f"SELECT series_id, time, t AS aqi_hourly_rolling, {sql.dominant('t')} AS dominant_pollutant, "
        f"{sql.category('t')} AS aqi_category "
        f"FROM (SELECT *, greatest({sql.columns(sql.SUBS)}) AS t FROM subs)",
        floats=["aqi_hourly_rolling"],
    ),
)
def hourly_aqi(spark, sf_dir):
    return aqi.describe_hourly_aqi(data.hourly_master(spark, sf_dir))


@query(
    "daily_aqi",
    sql.shaped("SELECT * FROM daily", floats=[*sql.SUBS, "aqi_us_epa"], days=["date"]),
)
def daily_aqi(spark, sf_dir):
    return aqi.daily_aqi(data.hourly_master(spark, sf_dir))


CONCENTRATION = (
    "round_even(CASE main_pollutant "
    + " ".join(f"WHEN '{s.removeprefix('aqi_')}' THEN {s.removeprefix('aqi_')}" for s in sql.SUBS)
    + " END, 1)"
)
LATEST = f"""
(SELECT *, coalesce({sql.dominant('t')}, 'pm2_5') AS main_pollutant
 FROM (SELECT m.*, x.* EXCLUDE (series_id, time), greatest({sql.columns(sql.SUBS)}) AS t
       FROM master m JOIN subs x ON x.series_id = m.series_id AND x.time = m.time
       QUALIFY row_number() OVER (PARTITION BY m.series_id ORDER BY m.time DESC) = 1))"""


@query(
    "current_aqi",
    sql.shaped(
        f"SELECT series_id, round_even(t, 1) AS aqi, {sql.category('t')} AS category, "
        f"main_pollutant, {CONCENTRATION} AS concentration FROM {LATEST}",
        floats=["aqi", "concentration"],
    ),
)
def current_aqi(spark, sf_dir):
    return aqi.current_aqi(data.hourly_master(spark, sf_dir))


@query(
    "current_conditions",
    sql.shaped(
        "SELECT series_id, time, round_even(temperature_2m, 1) AS temperature_2m, "
        "round_even(relative_humidity_2m, 1) AS relative_humidity_2m, "
        "round_even(wind_speed_10m, 1) AS wind_speed_10m, main_pollutant, "
        f"{CONCENTRATION} AS concentration FROM {LATEST}",
        floats=["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "concentration"],
    ),
)
def current_conditions(spark, sf_dir):
    return aqi.current_conditions(data.hourly_master(spark, sf_dir))


# ---- quality ----------------------------------------------------------------------


def cadence_sql(source: str, column: str, expected: str, offset: str) -> str:
    return f"""
SELECT series_id, n_rows, distinct_steps, invalid, first, last, expected_steps, aligned,
       n_rows - invalid - distinct_steps AS duplicates,
       greatest(expected_steps - distinct_steps, 0) AS missing_steps,
       invalid = 0 AND n_rows = distinct_steps AND expected_steps = distinct_steps AND aligned
         AS complete
FROM (SELECT series_id, count(*) AS n_rows, count(DISTINCT {column}) AS distinct_steps,
             count_if({column} IS NULL) AS invalid, min({column}) AS first, max({column}) AS last,
             {expected} + 1 AS expected_steps,
             min({offset}) = max({offset}) AS aligned
      FROM {source} GROUP BY series_id)"""


HOURLY_SPAN = "date_diff('hour', min(time), max(time))"
CADENCE_COUNTS = [
    "n_rows", "distinct_steps", "invalid", "expected_steps", "duplicates", "missing_steps",
]


@query(
    "validate_hourly_cadence",
    sql.shaped(
        cadence_sql("hours", "time", HOURLY_SPAN, "minute(time)"), whole=CADENCE_COUNTS
    ),
)
def validate_hourly_cadence(spark, sf_dir):
    return quality.validate_hourly_cadence(data.event_hours(spark, sf_dir))


@query(
    "validate_hourly_cadence_complete",
    sql.shaped(
        cadence_sql("master", "time", HOURLY_SPAN, "minute(time)"), whole=CADENCE_COUNTS
    ),
)
def validate_hourly_cadence_complete(spark, sf_dir):
    return quality.validate_hourly_cadence(data.hourly_master(spark, sf_dir))


@query(
    "validate_daily_cadence",
    sql.shaped(
        cadence_sql("ship", "date", "max(date) - min(date)", "0"),
        whole=CADENCE_COUNTS,
        days=["first", "last"],
    ),
)
def validate_daily_cadence(spark, sf_dir):
    lines = data.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("series_id"),
        F.to_date("l_shipdate").alias(DATE),
    )
    return quality.validate_daily_cadence(lines)


@query(
    "completeness",
    sql.shaped(
        "SELECT series_id, count(*) AS n_rows, count_if("
        + " OR ".join(f"{c} IS NULL" for c in sql.SUBS)
        + ") AS incomplete_rows FROM subs GROUP BY series_id",
        whole=["incomplete_rows"],
    ),
)
def completeness(spark, sf_dir):
    return quality.completeness(aqi.hourly_subindices(data.hourly_master(spark, sf_dir)), sql.SUBS)


@query(
    "gap_report",
    sql.shaped(
        "SELECT series_id, count(*) - count(DISTINCT time) AS duplicates, "
        f"{HOURLY_SPAN} + 1 AS expected_hours, "
        f"{HOURLY_SPAN} + 1 - count(DISTINCT time) AS missing_hours FROM hours GROUP BY series_id",
        whole=["duplicates", "expected_hours", "missing_hours"],
    ),
)
def gap_report(spark, sf_dir):
    return quality.gap_report(data.event_hours(spark, sf_dir))


@query(
    "missing_hours",
    sql.statement(
        "SELECT e.series_id, e.time FROM (SELECT series_id, "
        "unnest(generate_series(min(time), max(time), INTERVAL 1 HOUR)) AS time "
        "FROM hours GROUP BY series_id) e "
        "ANTI JOIN hours h ON h.series_id = e.series_id AND h.time = e.time"
    ),
)
def missing_hours(spark, sf_dir):
    return quality.missing_steps(data.event_hours(spark, sf_dir))


@query(
    "missing_value_report",
    sql.shaped(
        " UNION ALL ".join(
            f"SELECT series_id, '{c}' AS \"column\", count_if({c} IS NULL) AS missing "
            "FROM subs GROUP BY series_id"
            for c in ["time", *sql.SUBS]
        ),
        whole=["missing"],
    ),
)
def missing_value_report(spark, sf_dir):
    return quality.missing_value_report(aqi.hourly_subindices(data.hourly_master(spark, sf_dir)))


RANGED = ["pm2_5", "pm10", "ozone"]


@query(
    "range_report",
    sql.shaped(
        " UNION ALL ".join(
            f"SELECT series_id, '{c}' AS \"column\", count_if({c} < 0) AS negative, min({c}) AS min, "
            f"median({c}) AS median, max({c}) AS max FROM air GROUP BY series_id"
            for c in RANGED
        ),
        floats=["min", "median", "max"],
        whole=["negative"],
    ),
)
def range_report(spark, sf_dir):
    return quality.range_report(data.air_hourly(spark, sf_dir), RANGED)


START = "2024-01-01"


def raw_facts_sql(source: str) -> str:
    return (
        f"SELECT series_id, min(time) AS first, max(time) AS last, count(*) AS n_rows, "
        f"count(*) = count(DISTINCT time) AND count(*) = {HOURLY_SPAN} + 1 AS complete, "
        f"bool_and(starts_with(source, 'open_meteo_')) AS labelled FROM {source} GROUP BY series_id"
    )


CONTRACT = f"a.first = TIMESTAMP '{START}' AND w.first = a.first AND a.last = w.last AND a.labelled AND w.labelled"
RAW_FACTS = f"({raw_facts_sql('air')}) a JOIN ({raw_facts_sql('weather')}) w ON w.series_id = a.series_id"


@query(
    "raw_contract_check",
    sql.statement(
        f"SELECT a.series_id, CASE WHEN {CONTRACT} THEN 'PASS' ELSE 'REVIEW' END AS contract, "
        f"CASE WHEN {CONTRACT} AND a.complete AND w.complete THEN 'PASS' ELSE 'REVIEW' END AS verdict "
        f"FROM {RAW_FACTS}"
    ),
)
def raw_contract_check(spark, sf_dir):
    return quality.raw_contract_check(
        data.air_hourly(spark, sf_dir), data.weather_hourly(spark, sf_dir), START
    )


@query(
    "qc_summary",
    sql.shaped(
        "SELECT a.series_id, p.product, CASE p.product WHEN 'aqi_training' THEN a.n_rows ELSE w.n_rows END AS n_rows, "
        "CASE p.product WHEN 'aqi_training' THEN 11 ELSE 12 END AS n_columns, "
        "CASE p.product WHEN 'aqi_training' THEN a.first ELSE w.first END AS start, "
        "CASE p.product WHEN 'aqi_training' THEN a.last ELSE w.last END AS \"end\", "
        f"0 AS missing_cells, ({CONTRACT}) AS contract_pass "
        f"FROM {RAW_FACTS} CROSS JOIN (VALUES ('aqi_training'), ('weather_features')) p(product)",
        whole=["n_columns", "missing_cells"],
    ),
)
def qc_summary(spark, sf_dir):
    return quality.qc_summary(
        data.air_hourly(spark, sf_dir), data.weather_hourly(spark, sf_dir), START
    )


# ---- summaries ------------------------------------------------------------------------


@query(
    "daily_features",
    sql.shaped(
        "SELECT * FROM dfeat", floats=[*BASE_COLUMNS, *sql.SUBS, "aqi_us_epa"], days=["date"]
    ),
)
def daily_features(spark, sf_dir):
    return summary.daily_features(data.hourly_master(spark, sf_dir))


@query(
    "build_daily_features",
    sql.shaped(
        "SELECT * FROM dfeat", floats=[*BASE_COLUMNS, *sql.SUBS, "aqi_us_epa"], days=["date"]
    ),
)
def build_daily_features(spark, sf_dir):
    """From the two raw products: merge, windows and daily aggregate on one exchange each."""
    chunked = merge.merge_cut(
        data.air_hourly(spark, sf_dir),
        data.weather_hourly(spark, sf_dir),
        HOURLY_GRID,
        back=aqi.AQI_REACH,
    )
    return summary.daily_features_of(chunked)


@query(
    "annual_weather",
    sql.shaped("SELECT * FROM annual", floats=TREND_COLUMNS, whole=["year"]),
)
def annual_weather(spark, sf_dir):
    return summary.annual_weather(data.weather_trend_daily(spark, sf_dir))


@query(
    "monthly_climatology",
    sql.shaped(
        "SELECT series_id, month(date) AS month, avg(pm2_5) AS pm2_5 FROM daily_series GROUP BY 1, 2",
        floats=["pm2_5"],
        whole=["month"],
    ),
)
def monthly_climatology(spark, sf_dir):
    return summary.climatology(data.daily_series(spark, sf_dir), "month")


@query(
    "hourly_climatology",
    sql.shaped(
        "SELECT series_id, hour(time) AS hour, avg(pm2_5) AS pm2_5 FROM master GROUP BY 1, 2",
        floats=["pm2_5"],
        whole=["hour"],
    ),
)
def hourly_climatology(spark, sf_dir):
    return summary.climatology(data.hourly_master(spark, sf_dir), "hour")


@query(
    "climatology_extremes",
    sql.shaped(
        """
WITH m AS (SELECT series_id, month(date) AS month, round(avg(pm2_5), 9) AS pm2_5
           FROM daily_series GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pm2_5 DESC, month) AS hi,
                row_number() OVER (PARTITION BY series_id ORDER BY pm2_5, month) AS lo FROM m)
SELECT h.series_id, h.month AS highest_month, h.pm2_5 AS highest_pm2_5,
       l.month AS lowest_month, l.pm2_5 AS lowest_pm2_5
FROM r h JOIN r l ON l.series_id = h.series_id AND l.lo = 1 WHERE h.hi = 1""",
        floats=["highest_pm2_5", "lowest_pm2_5"],
        whole=["highest_month", "lowest_month"],
    ),
)
def climatology_extremes(spark, sf_dir):
    means = summary.climatology(data.daily_series(spark, sf_dir), "month")
    return summary.climatology_extremes(means.withColumn("pm2_5", F.round("pm2_5", 9)), "month")


@query(
    "aqi_category_counts",
    sql.statement(
        f"SELECT series_id, {sql.category('aqi_us_epa')} AS aqi_category, count(*) AS n "
        "FROM daily WHERE aqi_us_epa IS NOT NULL GROUP BY 1, 2"
    ),
)
def aqi_category_counts(spark, sf_dir):
    daily = aqi.daily_aqi(data.hourly_master(spark, sf_dir))
    return summary.aqi_category_counts(daily, DAILY_AQI, grid=DAILY_GRID)


@query(
    "recent_category_counts",
    sql.statement(
        f"SELECT series_id, {sql.category('aqi_hourly_rolling')} AS aqi_category, count(*) AS n "
        "FROM (SELECT * FROM haqi QUALIFY row_number() OVER "
        "(PARTITION BY series_id ORDER BY time DESC) <= 2160) "
        "WHERE aqi_hourly_rolling IS NOT NULL GROUP BY 1, 2"
    ),
)
def recent_category_counts(spark, sf_dir):
    """The report's tail of ninety days."""
    hourly = aqi.with_hourly_aqi(data.hourly_master(spark, sf_dir))
    return summary.aqi_category_counts(hourly, HOURLY_AQI, last=2160)


@query(
    "describe_aqi",
    sql.shaped(
        """
SELECT series_id, count(aqi_us_epa) AS count, round_even(avg(aqi_us_epa), 1) AS mean,
       round_even(stddev_samp(aqi_us_epa), 1) AS std, min(aqi_us_epa) AS min,
       round_even(quantile_cont(aqi_us_epa, 0.25), 1) AS p25,
       round_even(quantile_cont(aqi_us_epa, 0.5), 1) AS p50,
       round_even(quantile_cont(aqi_us_epa, 0.75), 1) AS p75, max(aqi_us_epa) AS max,
       min(CASE WHEN aqi_us_epa = top THEN date END) AS peak_day
FROM (SELECT *, max(aqi_us_epa) OVER (PARTITION BY series_id) AS top FROM daily)
WHERE aqi_us_epa IS NOT NULL GROUP BY series_id""",
        floats=["mean", "std", "min", "p25", "p50", "p75", "max"],
        days=["peak_day"],
    ),
)
def describe_aqi(spark, sf_dir):
    return summary.describe_aqi(aqi.daily_aqi(data.hourly_master(spark, sf_dir)))


@query(
    "coverage_stats",
    sql.shaped(
        "SELECT series_id, count(*) AS days, median(hour_count) AS median_hour_count, "
        "count_if(hour_count < 20) AS short_days FROM "
        "(SELECT series_id, CAST(time AS DATE) AS date, count(DISTINCT time) AS hour_count "
        "FROM hours GROUP BY 1, 2) GROUP BY series_id",
        floats=["median_hour_count"],
        whole=["short_days"],
    ),
)
def coverage_stats(spark, sf_dir):
    """Over the hours that have events, so the daily counts vary."""
    hours = data.event_hours(spark, sf_dir)
    days = hours.groupBy("series_id", F.to_date(TIME).alias(DATE)).agg(
        F.count_distinct(TIME).alias("hour_count")
    )
    return summary.coverage_stats(days)


OTHERS = [c for c in summary.CORRELATED_COLUMNS if c != "pm2_5"]


@query(
    "pollutant_correlations",
    sql.shaped(
        "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(correlation) DESC NULLS LAST, "
        "variable) AS rank FROM ("
        + " UNION ALL ".join(
            f"SELECT series_id, '{c}' AS variable, corr({c}, pm2_5) AS correlation FROM master "
            "GROUP BY series_id"
            for c in OTHERS
        )
        + ")",
        floats=["correlation"],
    ),
)
def pollutant_correlations(spark, sf_dir):
    return summary.pollutant_correlations(data.hourly_master(spark, sf_dir))


TREND_LONG = " UNION ALL ".join(
    f"SELECT series_id, year, '{v}' AS variable, {v} AS value FROM annual WHERE year < {TREND_YEAR}"
    for v in summary.TREND_VARIABLES
)


@query(
    "trend_per_decade",
    sql.shaped(
        f"""
SELECT series_id, variable, regr_slope(value, year) * 10 AS slope_per_decade,
       avg(CASE WHEN a <= 5 THEN value END) AS first_5y_mean,
       avg(CASE WHEN b <= 5 THEN value END) AS last_5y_mean
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, variable ORDER BY year) AS a,
                row_number() OVER (PARTITION BY series_id, variable ORDER BY year DESC) AS b
      FROM ({TREND_LONG})) GROUP BY 1, 2""",
        floats=["slope_per_decade", "first_5y_mean", "last_5y_mean"],
    ),
)
def trend_per_decade(spark, sf_dir):
    annual = summary.annual_weather(data.weather_trend_daily(spark, sf_dir))
    return summary.trend_per_decade(annual, TREND_YEAR)


@query(
    "trend_line",
    sql.shaped(
        f"""
SELECT l.series_id, l.year, l.variable, l.value, f.k * l.year + f.b AS fitted
FROM ({TREND_LONG}) l JOIN (SELECT series_id, variable, regr_slope(value, year) AS k,
                                   regr_intercept(value, year) AS b
                            FROM ({TREND_LONG}) GROUP BY 1, 2) f
ON f.series_id = l.series_id AND f.variable = l.variable""",
        floats=["value", "fitted"],
        whole=["year"],
    ),
)
def trend_line(spark, sf_dir):
    annual = summary.annual_weather(data.weather_trend_daily(spark, sf_dir))
    return summary.trend_line(annual, TREND_YEAR)


def downsample_sql(source: str, order: str, value: str, last: int, every: int) -> str:
    return f"""
SELECT series_id, {order}, round_even({value}, 1) AS aqi
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY {order}) AS rn
      FROM (SELECT * FROM {source} QUALIFY row_number() OVER
            (PARTITION BY series_id ORDER BY {order} DESC) <= {last})
      WHERE {value} IS NOT NULL) WHERE (rn - 1) % {every} = 0"""


@query(
    "downsample_hourly",
    sql.shaped(
        downsample_sql("haqi", "time", "aqi_hourly_rolling", 2160, 6), floats=["aqi"]
    ),
)
def downsample_hourly(spark, sf_dir):
    hourly = aqi.with_hourly_aqi(data.hourly_master(spark, sf_dir))
    return summary.downsample(hourly, HOURLY_AQI, 2160, 6, HOURLY_GRID)


@query(
    "downsample_daily",
    sql.shaped(
        downsample_sql("daily_series", "date", "aqi_us_epa", 730, 7), floats=["aqi"], days=["date"]
    ),
)
def downsample_daily(spark, sf_dir):
    return summary.downsample(data.daily_series(spark, sf_dir), DAILY_AQI, 730, 7, DAILY_GRID)


# ---- features and labels -----------------------------------------------------------------


@query(
    "hourly_lag_roll",
    sql.shaped("SELECT * FROM lag_roll", floats=[HOURLY_AQI, *TEMPORAL_COLUMNS]),
)
def hourly_lag_roll(spark, sf_dir):
    hourly = aqi.with_hourly_aqi(data.hourly_master(spark, sf_dir)).select(*SERIES_TIME, HOURLY_AQI)
    return features.add_hourly_lag_roll(hourly)


@query(
    "daily_lag_roll",
    sql.shaped(
        f"SELECT series_id, date, aqi_us_epa, pm2_5, {sql.named(sql.DAILY_LAG_ROLL)} FROM daily_series",
        floats=["aqi_us_epa", "pm2_5", *sql.DAILY_LAG_ROLL],
        days=["date"],
    ),
)
def daily_lag_roll(spark, sf_dir):
    return features.add_daily_lag_roll(data.daily_series(spark, sf_dir))


@query("hourly_targets", sql.shaped("SELECT * FROM targets", floats=TARGET_COLUMNS))
def hourly_targets(spark, sf_dir):
    return features.hourly_targets(aqi.with_hourly_aqi(data.hourly_master(spark, sf_dir)))


@query(
    "daily_targets",
    sql.shaped(
        f"SELECT series_id, date, aqi_us_epa, {sql.named(sql.DAILY_TARGETS)} FROM daily_series",
        floats=["aqi_us_epa", *sql.DAILY_TARGETS],
        days=["date"],
    ),
)
def daily_targets(spark, sf_dir):
    return features.daily_targets(data.daily_series(spark, sf_dir))


FEATURE_FLOATS = [c for c in hourly_feature_columns(BASE_COLUMNS) if c != "is_weekend"]


@query(
    "hourly_observations", sql.shaped("SELECT * FROM observations", floats=FEATURE_FLOATS)
)
def hourly_observations(spark, sf_dir):
    return features.hourly_training_frame(
        data.hourly_master(spark, sf_dir), include_targets=False
    )


FRAME_COLUMNS = (*SERIES_TIME, *hourly_feature_columns(BASE_COLUMNS), *TARGET_COLUMNS)
#: Folders of stored frames by their columns, for each application and set of tables.
STORED: dict[tuple[str, str], dict[tuple[str, ...], str]] = {}


def training(spark, sf_dir, columns: Sequence[str] = FRAME_COLUMNS) -> DataFrame:
    """The training frame as a stored table: splits and fits read it several times.

    Only the ``columns`` a job uses are stored, unless a table that has them already is.
    """
    tables = STORED.setdefault((spark.sparkContext.applicationId, sf_dir), {})
    held = next((found for found in tables if set(columns) <= set(found)), None)
    if held is None:
        held = tuple(columns)
        folder = shared_folder(spark, "hourly_features")
        frame = features.hourly_training_frame(data.hourly_master(spark, sf_dir)).select(*held)
        frame.write.option("compression", COMPRESSION).parquet(folder)
        tables[held] = folder
    return spark.read.parquet(tables[held]).select(*columns)


@query(
    "hourly_training_frame",
    sql.shaped("SELECT * FROM training", floats=[*FEATURE_FLOATS, *TARGET_COLUMNS]),
)
def hourly_training_frame(spark, sf_dir):
    return features.hourly_training_frame(data.hourly_master(spark, sf_dir))


@query(
    "daily_training_frame",
    sql.shaped(
        "SELECT * FROM daily_training",
        floats=[
            DAILY_AQI,
            *[c for c in sql.DAILY_FEATURES if c not in ("dow", "is_weekend")],
            *sql.DAILY_TARGETS,
        ],
        days=["date"],
    ),
)
def daily_training_frame(spark, sf_dir):
    return features.daily_training_frame(data.daily_series(spark, sf_dir))


@query(
    "latest_window",
    sql.shaped(
        f"SELECT series_id, time, {sql.columns(AIR_COLUMNS)} FROM air "
        f"WHERE time <= date_trunc('hour', TIMESTAMP '{AS_OF}') "
        "QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY time DESC) <= 168",
        floats=AIR_COLUMNS,
    ),
)
def latest_window(spark, sf_dir):
    """Stored hours end two days early, so every series is read from the fresh input."""
    fresh = data.air_hourly(spark, sf_dir).select(*SERIES_TIME, *AIR_COLUMNS)
    stored = fresh.where(F.col(TIME) <= F.lit("2024-01-18 12:00:00").cast("timestamp_ntz"))
    return features.latest_window(stored, AS_OF, fresh=fresh)


# ---- splits, baselines, evaluation ----------------------------------------------------------


@query(
    "chronological_split_hourly",
    sql.shaped(
        f"SELECT series_id, time, aqi_hourly_rolling, {sql.split_case('pos', 'n', 72)} AS split FROM placed",
        floats=[HOURLY_AQI],
    ),
)
def chronological_split_hourly(spark, sf_dir):
    frame = training(spark, sf_dir, [*SERIES_TIME, HOURLY_AQI])
    return splits.chronological_split(frame)


@query(
    "chronological_split_daily",
    sql.shaped(
        f"SELECT series_id, date, aqi_us_epa, {sql.split_case('pos', 'n', 3)} AS split FROM "
        "(SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, "
        "count(*) OVER (PARTITION BY series_id) AS n FROM daily_training)",
        floats=[DAILY_AQI],
        days=["date"],
    ),
)
def chronological_split_daily(spark, sf_dir):
    frame = features.daily_training_frame(data.daily_series(spark, sf_dir), keep_chunks=True)
    return splits.chronological_split(frame.select("series_id", DATE, CHUNK, DAILY_AQI), grid=DAILY_GRID)


def folds_sql(size: str) -> str:
    start = f"n - 3 * {size} + (fold - 1) * {size}"
    return f"""
SELECT series_id, time, fold, role FROM (
  SELECT *, CASE WHEN pos < {start} - 72 THEN 'train'
                 WHEN pos >= {start} AND pos < {start} + {size} THEN 'test' END AS role
  FROM placed CROSS JOIN (SELECT unnest([1, 2, 3]) AS fold)) WHERE role IS NOT NULL"""


@query("rolling_origin_folds", sql.shaped(folds_sql("168"), whole=["fold"]))
def rolling_origin_folds(spark, sf_dir):
    return splits.rolling_origin_folds(training(spark, sf_dir, SERIES_TIME))


@query("purged_cv_folds", sql.shaped(folds_sql("(n // 4)"), whole=["fold"]))
def purged_cv_folds(spark, sf_dir):
    return splits.purged_cv_folds(training(spark, sf_dir, SERIES_TIME))


PERSISTENCE = [baselines.prediction("persistence", o) for o in TARGET_COLUMNS]
SEASONAL = [baselines.prediction("seasonal_persistence", o) for o in TARGET_COLUMNS]


@query(
    "persistence_forecast",
    sql.shaped(
        f"SELECT series_id, time, {sql.columns(PERSISTENCE)} FROM forecasts", floats=PERSISTENCE
    ),
)
def persistence_forecast(spark, sf_dir):
    frame = training(spark, sf_dir, [*SERIES_TIME, HOURLY_AQI])
    return baselines.persistence_forecast(frame).select(*SERIES_TIME, *PERSISTENCE)


@query(
    "seasonal_persistence_forecast",
    sql.shaped(f"SELECT series_id, time, {sql.columns(SEASONAL)} FROM forecasts", floats=SEASONAL),
)
def seasonal_persistence_forecast(spark, sf_dir):
    frame = training(spark, sf_dir, [*SERIES_TIME, HOURLY_AQI])
    return baselines.seasonal_persistence_forecast(frame).select(*SERIES_TIME, *SEASONAL)


MODELS = ("persistence", "seasonal_persistence")


def baseline_forecasts(spark, sf_dir) -> DataFrame:
    """Labels with both baseline forecasts, made on the whole frame; for splits, which read the chunk and drop it."""
    frame = training(spark, sf_dir, [*SERIES_TIME, HOURLY_AQI, *TARGET_COLUMNS])
    return baselines.persistence_forecast(baselines.seasonal_persistence_forecast(frame, keep_chunks=True))


def holdout_cells(spark, sf_dir) -> DataFrame:
    split = splits.chronological_split(baseline_forecasts(spark, sf_dir))
    return evaluation.to_cells(split.where(F.col("split") == "test"), MODELS)


BY_OUTPUT = "SELECT series_id, model, output, {} FROM cells GROUP BY 1, 2, 3"


@query(
    "regression_metrics",
    sql.shaped(BY_OUTPUT.format(sql.named(sql.REGRESSION_SQL)), floats=sql.REGRESSION_SQL),
)
def regression_metrics(spark, sf_dir):
    metrics = evaluation.regression_metrics(holdout_cells(spark, sf_dir))
    return evaluation.name_outputs(metrics).drop("group")


@query(
    "category_metrics",
    sql.shaped(BY_OUTPUT.format(sql.named(sql.CATEGORY_SQL)), floats=sql.CATEGORY_SQL),
)
def category_metrics(spark, sf_dir):
    metrics = evaluation.category_metrics(holdout_cells(spark, sf_dir))
    return evaluation.name_outputs(metrics).drop("group")


@query(
    "evaluate_outputs",
    sql.shaped(
        "SELECT * FROM scores UNION ALL BY NAME SELECT * FROM group_scores", floats=sql.METRICS
    ),
)
def evaluate_outputs(spark, sf_dir):
    return evaluation.evaluate_outputs(holdout_cells(spark, sf_dir))


def fold_metrics(spark, sf_dir) -> DataFrame:
    rows = splits.rolling_origin_folds(baseline_forecasts(spark, sf_dir))
    tests = rows.where(F.col("role") == "test")
    return evaluation.evaluate_folds(evaluation.to_cells(tests, MODELS, ("series_id", "fold")))


def rolling(spark, sf_dir) -> DataFrame:
    return evaluation.rolling_origin_evaluation(fold_metrics(spark, sf_dir))


@query(
    "rolling_origin_evaluation", sql.shaped("SELECT * FROM rolling", floats=sql.METRICS)
)
def rolling_origin_evaluation(spark, sf_dir):
    return rolling(spark, sf_dir)


@query(
    "holdout_summary",
    sql.shaped(
        'SELECT series_id, model, "group", round_even(avg(rmse), 3) AS rmse, '
        "round_even(avg(mae), 3) AS mae, round_even(avg(r2), 3) AS r2 FROM scores GROUP BY 1, 2, 3",
        floats=["rmse", "mae", "r2"],
    ),
)
def holdout_summary(spark, sf_dir):
    scored = evaluation.evaluate_outputs(holdout_cells(spark, sf_dir))
    return summary.holdout_summary(scored.where(F.col("output") != "all"))


@query(
    "release_gate",
    sql.shaped(
        """
SELECT series_id, "pass", 'seasonal_persistence' AS best_model, best_rmse, baseline_rmse, best_mae,
       baseline_mae, groups_beaten,
       CASE WHEN "pass" THEN printf('seasonal_persistence beats persistence: RMSE %.2f < %.2f, MAE %.2f < %.2f, better in %d groups',
                                  best_rmse, baseline_rmse, best_mae, baseline_mae, groups_beaten)
            ELSE printf('seasonal_persistence does not beat persistence: RMSE %.2f vs %.2f, MAE %.2f vs %.2f',
                        best_rmse, baseline_rmse, best_mae, baseline_mae) END AS reason
FROM (SELECT *, best_rmse < baseline_rmse AND best_mae < baseline_mae AS "pass"
      FROM (SELECT s.series_id, avg(s.rmse) AS best_rmse, avg(p.rmse) AS baseline_rmse,
                   avg(s.mae) AS best_mae, avg(p.mae) AS baseline_mae,
                   count_if(s.rmse < p.rmse) AS groups_beaten
            FROM rolling s JOIN rolling p ON p.series_id = s.series_id AND p."group" = s."group"
            WHERE s.model = 'seasonal_persistence' AND p.model = 'persistence' GROUP BY 1))""",
        floats=["best_rmse", "baseline_rmse", "best_mae", "baseline_mae"],
        whole=["groups_beaten"],
    ),
)
def release_gate(spark, sf_dir):
    """With the seasonal baseline in the place of the trained candidates."""
    return evaluation.release_gate(rolling(spark, sf_dir), ("seasonal_persistence",))


@query(
    "select_model_by_group",
    sql.statement(
        'SELECT series_id, "group", arg_min(model, (rmse, model)) AS model FROM rolling GROUP BY 1, 2'
    ),
)
def select_model_by_group(spark, sf_dir):
    return evaluation.select_model_by_group(rolling(spark, sf_dir), MODELS)


def daily_persistence(spark, sf_dir) -> DataFrame:
    """Daily holdout scores of persistence per horizon."""
    frame = features.daily_training_frame(data.daily_series(spark, sf_dir), keep_chunks=True)
    split = splits.chronological_split(
        frame.select("series_id", DATE, CHUNK, DAILY_AQI, *sql.DAILY_TARGETS), grid=DAILY_GRID
    ).where(F.col("split") == "test")
    cells = split.select(
        "series_id",
        F.lit("persistence").alias("model"),
        F.col(DAILY_AQI).alias("yhat"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(h).alias("horizon_days"), F.col(f"target_{h}d").alias("y"))
                    for h in (1, 2, 3)
                ]
            )
        ),
    )
    return evaluation.regression_metrics(cells, ("series_id", "model", "horizon_days"))


@query(
    "daily_holdout_pivot",
    sql.shaped(
        "SELECT series_id, 'persistence' AS model, "
        + ", ".join(
            f"round_even(sqrt(avg((aqi_us_epa - target_{h}d) * (aqi_us_epa - target_{h}d))), 2) AS \"{h}d_rmse\""
            for h in (1, 2, 3)
        )
        + " FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS pos, "
        "count(*) OVER (PARTITION BY series_id) AS n FROM daily_training) "
        f"WHERE ({sql.split_case('pos', 'n', 3)}) = 'test' GROUP BY series_id",
        floats=['"1d_rmse"', '"2d_rmse"', '"3d_rmse"'],
    ),
)
def daily_holdout_pivot(spark, sf_dir):
    return summary.daily_holdout_pivot(daily_persistence(spark, sf_dir))
