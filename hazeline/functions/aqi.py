"""US EPA Air Quality Index as column expressions.

Arguments named ``value`` are column names or SQL expressions. The wide CASE
expressions are given to Spark as SQL text, which it parses in one call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.common import double, greatest_of

# US EPA breakpoints (concentration low, high, index low, high).
# PM in ug/m3, ozone and CO in ppm, SO2 and NO2 in ppb; PM2.5 as of May 2024.
BREAKPOINTS = {
    "pm2_5": [
        (0.0, 9.0, 0, 50),
        (9.1, 35.4, 51, 100),
        (35.5, 55.4, 101, 150),
        (55.5, 125.4, 151, 200),
        (125.5, 225.4, 201, 300),
        (225.5, 325.4, 301, 400),
        (325.5, 500.4, 401, 500),
    ],
    "pm10": [
        (0.0, 54.0, 0, 50),
        (55.0, 154.0, 51, 100),
        (155.0, 254.0, 101, 150),
        (255.0, 354.0, 151, 200),
        (355.0, 424.0, 201, 300),
        (425.0, 504.0, 301, 400),
        (505.0, 604.0, 401, 500),
    ],
    "ozone_8h": [
        (0.000, 0.054, 0, 50),
        (0.055, 0.070, 51, 100),
        (0.071, 0.085, 101, 150),
        (0.086, 0.105, 151, 200),
        (0.106, 0.200, 201, 300),
    ],
    "ozone_1h": [
        (0.125, 0.164, 101, 150),
        (0.165, 0.204, 151, 200),
        (0.205, 0.404, 201, 300),
        (0.405, 0.504, 301, 400),
        (0.505, 0.604, 401, 500),
    ],
    "carbon_monoxide": [
        (0.0, 4.4, 0, 50),
        (4.5, 9.4, 51, 100),
        (9.5, 12.4, 101, 150),
        (12.5, 15.4, 151, 200),
        (15.5, 30.4, 201, 300),
        (30.5, 40.4, 301, 400),
        (40.5, 50.4, 401, 500),
    ],
    "sulphur_dioxide": [
        (0.0, 35.0, 0, 50),
        (36.0, 75.0, 51, 100),
        (76.0, 185.0, 101, 150),
        (186.0, 304.0, 151, 200),
        (305.0, 604.0, 201, 300),
        (605.0, 1004.0, 301, 400),
        (1005.0, 1604.0, 401, 500),
    ],
    "nitrogen_dioxide": [
        (0.0, 53.0, 0, 50),
        (54.0, 100.0, 51, 100),
        (101.0, 360.0, 101, 150),
        (361.0, 649.0, 151, 200),
        (650.0, 1249.0, 201, 300),
        (1250.0, 1649.0, 301, 400),
        (1650.0, 2049.0, 401, 500),
    ],
}

# Decimals kept before interpolation.
TRUNCATION_DECIMALS = {
    "pm2_5": 1,
    "pm10": 0,
    "ozone_8h": 3,
    "ozone_1h": 3,
    "carbon_monoxide": 1,
    "sulphur_dioxide": 0,
    "nitrogen_dioxide": 0,
}

# Category upper bounds.
CATEGORIES = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
    (500, "Hazardous"),
]
CATEGORY_NAMES = tuple(name for _, name in CATEGORIES)
HIGH_AQI = 101

# ug/m3 to ppm (ozone, CO) and ppb (NO2, SO2) at 25 C and 1 atm.
UNIT_FACTORS = {
    "ozone": 24.45 / (48.0 * 1000.0),
    "carbon_monoxide": 24.45 / (28.01 * 1000.0),
    "nitrogen_dioxide": 24.45 / 46.005,
    "sulphur_dioxide": 24.45 / 64.066,
}

# Sub-index columns; a tie for dominance goes to the first.
SUBINDEX_ORDER = (
    "pm2_5",
    "pm10",
    "carbon_monoxide",
    "ozone",
    "sulphur_dioxide",
    "nitrogen_dioxide",
)


def subindex_name(pollutant: str) -> str:
    return f"aqi_{pollutant}"


def truncate_sql(value: str, decimals: int) -> str:
    factor = double(10**decimals)
    return f"(floor(({value}) * {factor}) / {factor})"


def epa_truncate(value: str, decimals: int) -> Column:
    """Cut a non-negative concentration to the decimals its table uses."""
    return F.expr(truncate_sql(value, decimals))


def units_sql(value: str, pollutant: str) -> str:
    factor = UNIT_FACTORS.get(pollutant)
    return value if factor is None else f"(({value}) * {double(factor)})"


def to_epa_units(value: str, pollutant: str) -> Column:
    """Mass concentration in the units of the pollutant's table."""
    return F.expr(units_sql(value, pollutant))


def _cut_sql(value: str, table: str, on_negative: str) -> str:
    """Truncated concentration; a negative one fails the job or is null."""
    message = f"raise_error(concat('negative {table} concentration: ', {value}))"
    negative = message if on_negative == "error" else "NULL"
    return f"CASE WHEN {value} < 0 THEN {negative} ELSE {truncate_sql(value, TRUNCATION_DECIMALS[table])} END"


def _row_sql(cut: str, table: str) -> str:
    """Number of the breakpoint row; one past the last above the table, null below it."""
    rows = BREAKPOINTS[table]
    arms = [f"WHEN {cut} < {double(rows[0][0])} THEN NULL"]
    arms += [f"WHEN {cut} <= {double(high)} THEN {i}" for i, (_, high, *_) in enumerate(rows)]
    return f"CASE {' '.join(arms)} WHEN {cut} IS NOT NULL THEN {len(rows)} END"


def _index_sql(cut: str, row: str, table: str) -> str:
    """Linear interpolation in the breakpoint row, rounded half up; 500 past the last row."""
    rows = [*BREAKPOINTS[table], (0.0, 1.0, 500, 500)]
    base, rise, low, run = (
        f"get(array({', '.join(double(v) for v in values)}), {row})"
        for values in (
            [a for _, _, a, _ in rows],
            [b - a for _, _, a, b in rows],
            [lo for lo, *_ in rows],
            [hi - lo for lo, hi, *_ in rows],
        )
    )
    return f"double(floor({base} + {rise} * ({cut} - {low}) / {run} + 0.5D))"


def _check(table: str, on_negative: str) -> None:
    if table not in BREAKPOINTS:
        raise KeyError(f"no AQI breakpoints for {table!r}")
    if on_negative not in ("error", "null"):
        raise ValueError("on_negative is 'error' or 'null'")


def aqi_subindex(value: str, table: str, on_negative: str = "error") -> Column:
    """Sub-index of a concentration given in the units of ``table``.

    Null stays null, values above the table score 500 and values below its first
    row have no index. A negative value fails the job, or is null on request.
    """
    _check(table, on_negative)
    cut = _cut_sql(value, table, on_negative)
    return F.expr(_index_sql(f"({cut})", f"({_row_sql(f'({cut})', table)})", table))


def with_subindices(
    df: DataFrame, values: dict[str, tuple[str, str]], on_negative: str = "error"
) -> DataFrame:
    """Add several sub-indices, given as name: (concentration in table units, table).

    Truncation, row and interpolation are columns of their own, which keeps the
    generated methods small enough for the JIT compiler.
    """
    for _, table in values.values():
        _check(table, on_negative)
    cuts = {f"_cut_{k}": F.expr(_cut_sql(v, t, on_negative)) for k, (v, t) in values.items()}
    rows = {f"_row_{k}": F.expr(_row_sql(f"_cut_{k}", t)) for k, (_, t) in values.items()}
    indices = {
        k: F.expr(_index_sql(f"_cut_{k}", f"_row_{k}", t)) for k, (_, t) in values.items()
    }
    return df.withColumns(cuts).withColumns(rows).withColumns(indices).drop(*cuts, *rows)


def category_sql(value: str) -> str:
    rounded = f"rint({value})"
    arms = [f"WHEN {rounded} < 0 THEN NULL"]
    arms += [f"WHEN {rounded} <= {double(high)} THEN '{name}'" for high, name in CATEGORIES[:-1]]
    return f"CASE {' '.join(arms)} WHEN {value} IS NOT NULL THEN '{CATEGORIES[-1][1]}' END"


def aqi_category(value: str) -> Column:
    """Category of an index rounded half to even; null below zero."""
    return F.expr(category_sql(value))


def band_sql(value: str) -> str:
    """Number of the category, for counting."""
    rounded = f"rint({value})"
    arms = [f"WHEN {rounded} < 0 THEN NULL"]
    arms += [f"WHEN {rounded} <= {double(high)} THEN {i}" for i, (high, _) in enumerate(CATEGORIES[:-1])]
    return f"CASE {' '.join(arms)} WHEN {value} IS NOT NULL THEN {len(CATEGORIES) - 1} END"


def dominant_pollutant(columns: list[str]) -> Column:
    """Pollutant with the largest sub-index; ties go to the first column."""
    top = greatest_of(columns)
    arms = [f"WHEN {c} = {top} THEN '{c.removeprefix('aqi_')}'" for c in columns]
    return F.expr(f"CASE {' '.join(arms)} END")
