"""The registered queries as DuckDB SQL over the driver tables.

Every statement is put together from the named steps below; a step is included
when the statement, directly or through other steps, mentions it.
"""

from __future__ import annotations

import re

from hazeline.functions.aqi import (
    BREAKPOINTS,
    CATEGORIES,
    SUBINDEX_ORDER,
    TRUNCATION_DECIMALS,
    UNIT_FACTORS,
)
from hazeline.schema import (
    AIR_COLUMNS,
    AIR_SOURCE,
    BASE_COLUMNS,
    DAILY_HORIZONS,
    DAILY_LAGS,
    DAILY_WINDOWS,
    OUTPUTS,
    TARGET_COLUMNS,
    TREND_COLUMNS,
    WEATHER_COLUMNS,
    WEATHER_SOURCE,
    daily_feature_columns,
    hourly_feature_columns,
)

STEPS: dict[str, str] = {}


def statement(body: str) -> str:
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(STEPS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in needed) + "\n" + body


def shaped(body: str, floats=(), whole=(), days=(), digits: int = 6) -> str:
    """``body`` with floats rounded, counts as BIGINT and dates as text."""
    swaps = [f"round({c}, {digits}) + 0.0 AS {c}" for c in floats]
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in whole]
    swaps += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in days]
    return statement(f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({body})" if swaps else body)


def num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def subindex(column: str, table: str) -> str:
    """CASE over a column that is already truncated."""
    rows = BREAKPOINTS[table]
    arms = [f"WHEN {column} IS NULL THEN NULL", f"WHEN {column} < {num(rows[0][0])} THEN NULL"]
    for low, high, index_low, index_high in rows:
        width = num(float(index_high - index_low))
        scaled = f"{num(float(index_low))} + {width} * ({column} - {num(low)}) / {num(high - low)}"
        arms.append(f"WHEN {column} <= {num(high)} THEN floor({scaled} + 0.5e0)")
    return "CASE " + " ".join(arms) + " ELSE 500e0 END"


def truncated(expression: str, table: str) -> str:
    factor = num(float(10 ** TRUNCATION_DECIMALS[table]))
    return f"floor(({expression}) * {factor}) / {factor}"


def category(column: str) -> str:
    arms = [f"WHEN {column} IS NULL OR round_even({column}, 0) < 0 THEN NULL"]
    for high, name in CATEGORIES[:-1]:
        arms.append(f"WHEN round_even({column}, 0) <= {high} THEN '{name}'")
    return "CASE " + " ".join(arms) + f" ELSE '{CATEGORIES[-1][1]}' END"


def band(column: str) -> str:
    arms = [f"WHEN {column} IS NULL OR round_even({column}, 0) < 0 THEN NULL"]
    for i, (high, _) in enumerate(CATEGORIES[:-1]):
        arms.append(f"WHEN round_even({column}, 0) <= {high} THEN {i}")
    return "CASE " + " ".join(arms) + f" ELSE {len(CATEGORIES) - 1} END"


SUBS = [f"aqi_{p}" for p in SUBINDEX_ORDER]


def dominant(top: str, columns=SUBS) -> str:
    return "CASE " + " ".join(
        f"WHEN {c} = {top} THEN '{c.removeprefix('aqi_')}'" for c in columns
    ) + " END"


def columns(names) -> str:
    return ", ".join(names)


# ---- inputs -----------------------------------------------------------------

STEPS["hours"] = """
SELECT 'u' || user_id AS series_id, date_trunc('hour', ts) AS time,
       CAST(round(value * 100) AS BIGINT) AS amount
FROM events"""
STEPS["span"] = "SELECT min(time) AS lo, max(time) AS hi FROM hours"
STEPS["base"] = """
SELECT k.series_id, t.time, count(h.amount) AS c,
       CAST(coalesce(sum(h.amount), 0) AS BIGINT) AS s,
       coalesce(min(h.amount), 0) AS mn, coalesce(max(h.amount), 0) AS mx
FROM (SELECT DISTINCT series_id FROM hours) k
CROSS JOIN (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS time FROM span) t
LEFT JOIN hours h ON h.series_id = k.series_id AND h.time = t.time
GROUP BY k.series_id, t.time"""

AIR_SQL = {
    "pm10": "floor(mx / 1e1) * 2e0",
    "pm2_5": "s / 1e1",
    "carbon_monoxide": "s * 2e0",
    "nitrogen_dioxide": "mx / 5e1",
    "sulphur_dioxide": "mn / 1e2",
    "ozone": "s * 4e0 / 1e2",
    "aerosol_optical_depth": "mn / 1e3",
    "dust": "s / 1e3",
    "uv_index": "c * 1e0",
}
WEATHER_SQL = {
    "temperature_2m": "1e1 + hour(time)",
    "relative_humidity_2m": "3e1 + (day(time) * 7 + hour(time) * 3) % 60",
    "dew_point_2m": "5e0 + hour(time) + day(time) % 5",
    "precipitation": "(c % 3) * 1e0",
    "rain": "(c % 2) * 1e0",
    "surface_pressure": "9e2 + s % 50",
    "cloud_cover": "(s * 7 % 101) * 1e0",
    "wind_speed_10m": "(s % 200) / 1e1",
    "wind_direction_10m": "(s * 13 % 360) * 1e0",
    "wind_gusts_10m": "(s % 200) / 1e1 + 5e0",
}


def measured(names, expressions) -> str:
    return ", ".join(f"CAST({expressions[c]} AS DOUBLE) AS {c}" for c in names)


STEPS["air"] = (
    f"SELECT series_id, time, {measured(AIR_COLUMNS, AIR_SQL)}, '{AIR_SOURCE}' AS source FROM base"
)
STEPS["weather"] = (
    f"SELECT series_id, time, {measured(WEATHER_COLUMNS, WEATHER_SQL)}, "
    f"'{WEATHER_SOURCE}' AS source FROM base"
)
STEPS["master"] = (
    f"SELECT series_id, time, {measured(BASE_COLUMNS, {**AIR_SQL, **WEATHER_SQL})} FROM base"
)
STEPS["ship"] = """
SELECT 's' || l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date,
       CAST(round(l_quantity) AS BIGINT) AS quantity
FROM lineitem"""
STEPS["daily_series"] = """
SELECT k.series_id, d.date, CAST(count(h.quantity) AS DOUBLE) AS aqi_us_epa,
       coalesce(sum(h.quantity), 0) / 1e1 AS pm2_5
FROM (SELECT DISTINCT series_id FROM ship) k
CROSS JOIN (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                               INTERVAL 1 DAY)) AS DATE) AS date
            FROM (SELECT min(date) AS lo, max(date) AS hi FROM ship)) d
LEFT JOIN ship h ON h.series_id = k.series_id AND h.date = d.date
GROUP BY k.series_id, d.date"""

TREND_SQL = {
    "temperature_2m_mean": "(t % 4000) / 1e2",
    "temperature_2m_max": "(t % 4000) / 1e2 + 5e0",
    "temperature_2m_min": "(t % 4000) / 1e2 - 5e0",
    "precipitation_sum": "(n % 10) * 1e0",
    "rain_sum": "(n % 7) * 1e0",
    "wind_speed_10m_mean": "(t % 300) / 1e1",
    "wind_gusts_10m_max": "(t % 300) / 1e1 + 1e1",
    "relative_humidity_2m_mean": "(t % 100) * 1e0",
}
STEPS["trend"] = f"""
SELECT series_id, date, {measured(TREND_COLUMNS, TREND_SQL)}
FROM (SELECT 'n' || c_nationkey AS series_id, CAST(o_orderdate AS DATE) AS date,
             CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS t, count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

# ---- AQI --------------------------------------------------------------------

WINDOW = "(PARTITION BY series_id ORDER BY time ROWS BETWEEN {} AND {})"


def frame(start: int, end: int, order: str = "time") -> str:
    def edge(n):
        if n == 0:
            return "CURRENT ROW"
        return f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    return (
        f"(PARTITION BY series_id ORDER BY {order} ROWS BETWEEN {edge(start)} AND {edge(end)})"
    )


def full_mean(column: str, start: int, end: int, order: str = "time") -> str:
    over = frame(start, end, order)
    return (
        f"CASE WHEN count({column}) OVER {over} = {end - start + 1} "
        f"THEN avg({column}) OVER {over} END"
    )


def full_std(column: str, rows: int, order: str = "time") -> str:
    over = frame(-(rows - 1), 0, order)
    return (
        f"CASE WHEN count({column}) OVER {over} = {rows} THEN stddev_samp({column}) OVER {over} END"
    )


STEPS["means"] = f"""
SELECT series_id, time, ozone, sulphur_dioxide, nitrogen_dioxide,
       round(({full_mean('pm2_5', -23, 0)}) * 1e9) / 1e9 AS pm25_24,
       round(({full_mean('pm10', -23, 0)}) * 1e9) / 1e9 AS pm10_24,
       round(({full_mean('carbon_monoxide', -7, 0)}) * 1e9) / 1e9 AS co_8,
       round(({full_mean('ozone', -7, 0)}) * 1e9) / 1e9 AS o3_8
FROM master"""


def factor(pollutant: str) -> str:
    return num(UNIT_FACTORS[pollutant])


STEPS["cuts"] = f"""
SELECT series_id, time,
       {truncated('pm25_24', 'pm2_5')} AS v_pm25,
       {truncated('pm10_24', 'pm10')} AS v_pm10,
       {truncated('co_8 * ' + factor('carbon_monoxide'), 'carbon_monoxide')} AS v_co,
       {truncated('o3_8 * ' + factor('ozone'), 'ozone_8h')} AS v_o8,
       {truncated('ozone * ' + factor('ozone'), 'ozone_1h')} AS v_o1,
       {truncated('sulphur_dioxide * ' + factor('sulphur_dioxide'), 'sulphur_dioxide')} AS v_so2,
       {truncated('nitrogen_dioxide * ' + factor('nitrogen_dioxide'), 'nitrogen_dioxide')} AS v_no2
FROM means"""
STEPS["subs"] = f"""
SELECT series_id, time,
       {subindex('v_pm25', 'pm2_5')} AS aqi_pm2_5,
       {subindex('v_pm10', 'pm10')} AS aqi_pm10,
       {subindex('v_co', 'carbon_monoxide')} AS aqi_carbon_monoxide,
       greatest({subindex('v_o8', 'ozone_8h')}, {subindex('v_o1', 'ozone_1h')}) AS aqi_ozone,
       {subindex('v_so2', 'sulphur_dioxide')} AS aqi_sulphur_dioxide,
       {subindex('v_no2', 'nitrogen_dioxide')} AS aqi_nitrogen_dioxide
FROM cuts"""
STEPS["haqi"] = (
    f"SELECT series_id, time, greatest({columns(SUBS)}) AS aqi_hourly_rolling FROM subs"
)
STEPS["day_cuts"] = f"""
SELECT m.series_id, CAST(m.time AS DATE) AS date,
       {truncated("round((CASE WHEN count(pm2_5) = 24 THEN avg(pm2_5) END) * 1e9) / 1e9", 'pm2_5')} AS v_pm25,
       {truncated("round((CASE WHEN count(pm10) = 24 THEN avg(pm10) END) * 1e9) / 1e9", 'pm10')} AS v_pm10,
       max(aqi_carbon_monoxide) AS aqi_carbon_monoxide, max(aqi_ozone) AS aqi_ozone,
       max(aqi_sulphur_dioxide) AS aqi_sulphur_dioxide,
       max(aqi_nitrogen_dioxide) AS aqi_nitrogen_dioxide
FROM master m JOIN subs x ON x.series_id = m.series_id AND x.time = m.time GROUP BY 1, 2"""
STEPS["day_subs"] = f"""
SELECT series_id, date, {subindex('v_pm25', 'pm2_5')} AS aqi_pm2_5,
       {subindex('v_pm10', 'pm10')} AS aqi_pm10, {columns(SUBS[2:])}
FROM day_cuts"""
STEPS["daily"] = f"""
SELECT series_id, date, {columns(SUBS)}, aqi_us_epa, {category('aqi_us_epa')} AS aqi_category,
       {dominant('aqi_us_epa')} AS dominant_pollutant
FROM (SELECT *, greatest({columns(SUBS)}) AS aqi_us_epa FROM day_subs)"""
DAY_MEASURES = ", ".join(
    f"coalesce(sum({c}), 0e0) AS {c}" if c in ("precipitation", "rain") else f"avg({c}) AS {c}"
    for c in BASE_COLUMNS
)
STEPS["dfeat"] = f"""
SELECT m.*, d.* EXCLUDE (series_id, date)
FROM (SELECT series_id, CAST(time AS DATE) AS date, {DAY_MEASURES}, count(pm2_5) AS hour_count
      FROM master GROUP BY 1, 2) m
LEFT JOIN daily d ON d.series_id = m.series_id AND d.date = m.date
WHERE m.pm2_5 IS NOT NULL AND d.aqi_us_epa IS NOT NULL"""

# ---- features and labels ------------------------------------------------------

HOURLY_LAG_ROLL = {
    "aqi_lag_1h": "lag(aqi_hourly_rolling, 1) OVER (PARTITION BY series_id ORDER BY time)",
    "aqi_lag_24h": "lag(aqi_hourly_rolling, 24) OVER (PARTITION BY series_id ORDER BY time)",
    "aqi_rolling_6h_mean": full_mean("aqi_hourly_rolling", -5, 0),
    "aqi_rolling_24h_mean": full_mean("aqi_hourly_rolling", -23, 0),
    "aqi_rolling_6h_std": full_std("aqi_hourly_rolling", 6),
    "aqi_rolling_24h_std": full_std("aqi_hourly_rolling", 24),
}
TARGETS = {
    name: f"lead(aqi_hourly_rolling, {a}) OVER (PARTITION BY series_id ORDER BY time)"
    if a == b
    else full_mean("aqi_hourly_rolling", a, b)
    for name, _, _, a, b in OUTPUTS
}


def named(expressions: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in expressions.items())


STEPS["lag_roll"] = f"SELECT series_id, time, aqi_hourly_rolling, {named(HOURLY_LAG_ROLL)} FROM haqi"
STEPS["targets"] = f"SELECT series_id, time, {named(TARGETS)} FROM haqi"


def cycle(function: str, value: str, period: str) -> str:
    return f"{function}({value} * (2e0 * pi()) / {period})"


DOW = "(isodow({0}) - 1)"
HOURLY_CALENDAR = {
    "hour_sin": cycle("sin", "hour(time)", "24e0"),
    "hour_cos": cycle("cos", "hour(time)", "24e0"),
    "dow_sin": cycle("sin", DOW.format("time"), "7e0"),
    "dow_cos": cycle("cos", DOW.format("time"), "7e0"),
    "is_weekend": f"CAST({DOW.format('time')} >= 5 AS BIGINT)",
    "month_sin": cycle("sin", "month(time)", "12e0"),
    "month_cos": cycle("cos", "month(time)", "12e0"),
}
DAILY_CALENDAR = {
    "month_sin": cycle("sin", "month(date)", "12e0"),
    "month_cos": cycle("cos", "month(date)", "12e0"),
    "dow": f"CAST({DOW.format('date')} AS BIGINT)",
    "is_weekend": f"CAST({DOW.format('date')} >= 5 AS BIGINT)",
    "day_of_year_sin": cycle("sin", "dayofyear(date)", "365.25e0"),
    "day_of_year_cos": cycle("cos", "dayofyear(date)", "365.25e0"),
}
HOURLY_FEATURES = hourly_feature_columns(BASE_COLUMNS)


def all_present(names) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in names)


STEPS["observations"] = f"""
SELECT series_id, time, {columns(HOURLY_FEATURES)}
FROM (SELECT m.*, l.* EXCLUDE (series_id, time), {named(HOURLY_CALENDAR).replace('(time)', '(m.time)')}
      FROM master m JOIN lag_roll l ON l.series_id = m.series_id AND l.time = m.time)
WHERE {all_present(HOURLY_FEATURES)}"""
STEPS["training"] = f"""
SELECT o.*, t.* EXCLUDE (series_id, time)
FROM observations o JOIN targets t ON t.series_id = o.series_id AND t.time = o.time
WHERE {all_present(TARGET_COLUMNS)}"""

DAILY_LAG_ROLL = {}
for k in DAILY_LAGS:
    for c in ("aqi_us_epa", "pm2_5"):
        DAILY_LAG_ROLL[f"{c}_lag{k}"] = f"lag({c}, {k}) OVER (PARTITION BY series_id ORDER BY date)"
for k in DAILY_WINDOWS:
    for c in ("aqi_us_epa", "pm2_5"):
        DAILY_LAG_ROLL[f"{c}_roll_mean{k}"] = full_mean(c, -(k - 1), 0, "date")
    DAILY_LAG_ROLL[f"aqi_us_epa_roll_std{k}"] = full_std("aqi_us_epa", k, "date")
DAILY_TARGETS = {
    f"target_{h}d": f"lead(aqi_us_epa, {h}) OVER (PARTITION BY series_id ORDER BY date)"
    for h in DAILY_HORIZONS
}
DAILY_FEATURES = daily_feature_columns(["pm2_5"])
STEPS["daily_training"] = f"""
SELECT series_id, date, aqi_us_epa, {columns(DAILY_FEATURES)}, {columns(DAILY_TARGETS)}
FROM (SELECT *, {named(DAILY_LAG_ROLL)}, {named(DAILY_TARGETS)}, {named(DAILY_CALENDAR)}
      FROM daily_series)
WHERE {all_present([*DAILY_LAG_ROLL, *DAILY_TARGETS])}"""

# ---- splits, baselines, metrics -------------------------------------------------

STEPS["placed"] = """
SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS pos,
       count(*) OVER (PARTITION BY series_id) AS n
FROM training"""


def split_case(pos: str, n: str, gap: int) -> str:
    at = f"floor({n} * {num(1 - 0.2)})"
    return (
        f"CASE WHEN {pos} >= {at} THEN 'test' WHEN {pos} < {at} - {gap} THEN 'train' "
        "ELSE 'purged' END"
    )


def seasonal(name: str, start: int, end: int) -> str:
    lag = 24 * ((end + 23) // 24)
    if start == end:
        return f"lag(aqi_hourly_rolling, {lag - start}) OVER (PARTITION BY series_id ORDER BY time)"
    return full_mean("aqi_hourly_rolling", start - lag, end - lag)


SEASONAL = {f"seasonal_persistence__{n}": seasonal(n, a, b) for n, _, _, a, b in OUTPUTS}
STEPS["forecasts"] = f"""
SELECT *, {', '.join(f'aqi_hourly_rolling AS persistence__{o}' for o in TARGET_COLUMNS)},
       {named(SEASONAL)}
FROM placed"""
CELLS = ", ".join(
    f"{{'model': '{m}', 'output': '{name}', 'group': '{group}', 'y': {name}, 'yhat': {m}__{name}}}"
    for m in ("persistence", "seasonal_persistence")
    for name, group, *_ in OUTPUTS
)
FOLD = "CAST(floor((pos - (n - 3 * 168)) / 168.0) AS BIGINT) + 1"
STEPS["test_rows"] = f"SELECT * FROM forecasts WHERE ({split_case('pos', 'n', 72)}) = 'test'"
STEPS["fold_rows"] = f"SELECT *, {FOLD} AS fold FROM forecasts WHERE pos >= n - 3 * 168"


def long_form(source: str, keep: str) -> str:
    return f"""
SELECT {keep}, u.model AS model, u.output AS output, u."group" AS "group", u.y AS y, u.yhat AS yhat,
       {band('u.y')} AS by_, {band('u.yhat')} AS bp_
FROM (SELECT {keep}, unnest([{CELLS}]) AS u FROM {source})"""


STEPS["cells"] = long_form("test_rows", "series_id")
STEPS["fold_cells"] = long_form("fold_rows", "series_id, fold")

F1 = " + ".join(
    f"coalesce(2e0 * count_if(by_ = {b} AND bp_ = {b}) / nullif(count_if(by_ = {b}) + count_if(bp_ = {b}), 0), 0e0)"
    for b in range(len(CATEGORIES))
)
REGRESSION_SQL = {
    "mse": "avg((yhat - y) * (yhat - y))",
    "rmse": "sqrt(avg((yhat - y) * (yhat - y)))",
    "mae": "avg(abs(yhat - y))",
    "r2": "CASE WHEN min(y) = max(y) THEN CASE WHEN sum((yhat - y) * (yhat - y)) = 0 THEN 1e0 "
    "ELSE 0e0 END ELSE 1e0 - sum((yhat - y) * (yhat - y)) / (var_pop(y) * count(y)) END",
}
CATEGORY_SQL = {
    "category_accuracy": "avg(CASE WHEN by_ IS NOT DISTINCT FROM bp_ THEN 1e0 ELSE 0e0 END)",
    "category_macro_f1": f"({F1}) / 6e0",
    "high_aqi_recall": "coalesce(count_if(y >= 101 AND yhat >= 101) * 1e0 "
    "/ nullif(count_if(y >= 101), 0), 0e0)",
}
METRIC_SQL = {**REGRESSION_SQL, **CATEGORY_SQL}
METRICS = list(METRIC_SQL)
STEPS["scores"] = f"""
SELECT series_id, model, "group", output, {named(METRIC_SQL)} FROM cells GROUP BY 1, 2, 3, 4"""
STEPS["group_scores"] = f"""
SELECT series_id, model, "group", 'all' AS output, {named(METRIC_SQL)} FROM cells GROUP BY 1, 2, 3"""
STEPS["fold_scores"] = f"""
SELECT series_id, fold, model, "group", output, {named(METRIC_SQL)}
FROM fold_cells GROUP BY 1, 2, 3, 4, 5"""
STEPS["rolling"] = f"""
SELECT series_id, model, "group", {', '.join(f'avg({m}) AS {m}' for m in METRICS)}
FROM fold_scores GROUP BY 1, 2, 3"""
STEPS["annual"] = """
SELECT series_id, year(date) AS year, avg(temperature_2m_mean) AS temperature_2m_mean,
       avg(temperature_2m_max) AS temperature_2m_max, avg(temperature_2m_min) AS temperature_2m_min,
       sum(precipitation_sum) AS precipitation_sum, sum(rain_sum) AS rain_sum,
       avg(wind_speed_10m_mean) AS wind_speed_10m_mean, max(wind_gusts_10m_max) AS wind_gusts_10m_max,
       avg(relative_humidity_2m_mean) AS relative_humidity_2m_mean
FROM trend GROUP BY 1, 2"""
