"""Lag, rolling and label columns, and the training frames built from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.calendar import add_daily_calendar, add_hourly_calendar
from hazeline.functions.common import any_null, fail_when, hour_floor, hours, present
from hazeline.operators.aqi import AQI_REACH, add_hourly_aqi, last_rows, subindex_columns
from hazeline.operators.chunks import (
    CHUNK,
    DAILY_GRID,
    HOURLY_GRID,
    Chunked,
    Grid,
    cut,
    sums_name,
    without_offsets,
)
from hazeline.schema import (
    BASE_COLUMNS,
    DAILY_AQI,
    DAILY_HORIZONS,
    DAILY_LAGS,
    DAILY_WINDOWS,
    HOURLY_AQI,
    HOURLY_LAGS,
    HOURLY_WINDOWS,
    KEYS,
    OUTPUTS,
    TARGET_COLUMNS,
    TIME,
    daily_feature_columns,
    hourly_feature_columns,
)

# Steps a feature or label reads on either side of its row.
HOURLY_LAG_REACH = max(HOURLY_LAGS)
HOURLY_REACH = AQI_REACH + HOURLY_LAG_REACH
LABEL_REACH = max(end for *_, end in OUTPUTS)
DAILY_REACH = max(DAILY_LAGS)
DAILY_LABEL_REACH = max(DAILY_HORIZONS)


# AQI values are whole numbers, so their sums and squares in thousandths are exact.
AQI_UNITS = 1e3


WINDOW_ENDS = tuple(-k for k in HOURLY_WINDOWS)
BLOCK_ENDS = tuple(sorted({k for *_, a, b in OUTPUTS if a != b for k in (a - 1, b)}))


def with_aqi_sums(chunked: Chunked, ends: Iterable[int]) -> Chunked:
    """Running sums of the hourly AQI, also at the ends of frames; a value with more than three decimals fails the job."""
    units = F.col(HOURLY_AQI) * AQI_UNITS
    exact = fail_when(
        F.abs(units - F.rint(units)) > 1e-6, "an AQI has more than three decimals", F.col(HOURLY_AQI)
    )
    summed = chunked.then(lambda c: c.df.withColumn(HOURLY_AQI, exact)).with_sums(
        [HOURLY_AQI], AQI_UNITS, squares=True
    )
    return summed.with_offsets({sums_name(HOURLY_AQI): ends})


def hourly_lag_roll_columns(chunked: Chunked, aqi: str = HOURLY_AQI) -> dict[str, Column]:
    """Needs the running sums of :func:`with_aqi_sums`."""
    columns = {f"aqi_lag_{k}h": chunked.lag(aqi, k) for k in HOURLY_LAGS}
    for k in HOURLY_WINDOWS:
        columns[f"aqi_rolling_{k}h_mean"] = F.expr(chunked.summed_mean(aqi, 1 - k, 0, AQI_UNITS))
        columns[f"aqi_rolling_{k}h_std"] = F.expr(chunked.summed_std(aqi, k, AQI_UNITS))
    return columns


def hourly_target_columns(chunked: Chunked, aqi: str = HOURLY_AQI) -> dict[str, Column]:
    """The hourly AQI needs the running sums of :func:`with_aqi_sums`; other columns may hold any numbers."""

    def block(start: int, end: int) -> Column:
        if aqi == HOURLY_AQI:
            return F.expr(chunked.summed_mean(aqi, start, end, AQI_UNITS))
        return chunked.mean(aqi, start, end)

    return {
        name: chunked.lead(aqi, start) if start == end else block(start, end)
        for name, _, _, start, end in OUTPUTS
    }


def with_daily_lags(chunked: Chunked) -> Chunked:
    """Look up every lag once that :func:`daily_lag_roll_columns` names."""
    return chunked.with_offsets({c: range(-DAILY_REACH, 0) for c in (DAILY_AQI, "pm2_5")})


def daily_lag_roll_columns(chunked: Chunked) -> dict[str, Column]:
    aqi, pm = DAILY_AQI, "pm2_5"
    columns = {}
    for k in DAILY_LAGS:
        columns |= {f"{c}_lag{k}": F.expr(chunked.at(c, -k)) for c in (aqi, pm)}
    for k in DAILY_WINDOWS:
        columns[f"{aqi}_roll_mean{k}"] = chunked.lagged_mean(aqi, k)
        columns[f"{aqi}_roll_std{k}"] = chunked.lagged_std(aqi, k)
        columns[f"{pm}_roll_mean{k}"] = chunked.lagged_mean(pm, k)
    return columns


def daily_target_columns(chunked: Chunked, horizons=DAILY_HORIZONS) -> dict[str, Column]:
    return {f"target_{h}d": chunked.lead(DAILY_AQI, h) for h in horizons}


def add_hourly_lag_roll(df: DataFrame, keys=KEYS, grid: Grid = HOURLY_GRID) -> DataFrame:
    """AQI lags of 1 and 24 hours, rolling mean and sample deviation over 6 and 24."""
    chunked = with_aqi_sums(cut(df, grid, back=HOURLY_LAG_REACH, keys=keys).guarded(), WINDOW_ENDS)
    added = chunked.then(lambda c: c.df.withColumns(hourly_lag_roll_columns(c)))
    return without_offsets(added.result().drop(sums_name(HOURLY_AQI)))


def hourly_targets(
    df: DataFrame, aqi: str = HOURLY_AQI, keys=KEYS, grid: Grid = HOURLY_GRID
) -> DataFrame:
    """The 30 labels: 24 hourly points, four 6-hour and two 12-hour means.

    A block mean with any missing hour is null.
    """
    chunked = cut(df.select(*keys, grid.column, aqi), grid, back=1, ahead=LABEL_REACH, keys=keys)
    guarded = chunked.guarded()
    summed = with_aqi_sums(guarded, BLOCK_ENDS) if aqi == HOURLY_AQI else guarded
    labelled = summed.then(lambda c: c.df.withColumns(hourly_target_columns(c, aqi)))
    return labelled.result().select(*keys, grid.column, *TARGET_COLUMNS)


def add_daily_lag_roll(df: DataFrame, keys=KEYS, grid: Grid = DAILY_GRID) -> DataFrame:
    chunked = with_daily_lags(cut(df, grid, back=DAILY_REACH, keys=keys).guarded())
    return without_offsets(chunked.then(lambda c: c.df.withColumns(daily_lag_roll_columns(c))).result())


def daily_targets(
    df: DataFrame, horizons=DAILY_HORIZONS, keys=KEYS, grid: Grid = DAILY_GRID
) -> DataFrame:
    chunked = cut(
        df.select(*keys, grid.column, DAILY_AQI), grid, ahead=max(horizons), keys=keys
    ).guarded()
    return chunked.then(lambda c: c.df.withColumns(daily_target_columns(c, horizons))).result()


def hourly_training_frame_of(
    chunked: Chunked, include_targets: bool = True, drop_unlabelled: bool = True
) -> DataFrame:
    """Features, and labels if asked for, of hourly rows cut with the frame's reach."""
    measures = present(chunked.df, BASE_COLUMNS)
    indexed = chunked.then(add_hourly_aqi)
    complete = indexed.then(
        lambda c: c.df.withColumn(
            HOURLY_AQI,
            fail_when(any_null(measures), "missing observed values", F.col(HOURLY_AQI)),
        ).drop(*subindex_columns(chunked.df))
    )

    def window_columns(c: Chunked) -> DataFrame:
        columns = hourly_lag_roll_columns(c)
        if include_targets:
            columns |= hourly_target_columns(c)
        return c.df.withColumns(columns)

    features = hourly_feature_columns(measures)
    targets = list(TARGET_COLUMNS) if include_targets else []
    summed = with_aqi_sums(complete, [*WINDOW_ENDS, *BLOCK_ENDS] if include_targets else WINDOW_ENDS)
    frame = add_hourly_calendar(summed.then(window_columns).result(), chunked.grid.column)
    required = [*features, *targets] if drop_unlabelled else features
    return frame.select(*chunked.keys, chunked.grid.column, *features, *targets).dropna(
        subset=required
    )


def hourly_training_frame(
    df: DataFrame,
    include_targets: bool = True,
    drop_unlabelled: bool = True,
    keys=KEYS,
    grid: Grid = HOURLY_GRID,
) -> DataFrame:
    """AQI, observed measures, lags, rolling statistics and calendar, then the labels.

    Rows with any null are dropped after the windows ran. A missing observation,
    a duplicate hour or a gap fails the job. Without ``drop_unlabelled`` rows whose
    labels are not known yet stay, with null labels.
    """
    keep = df.select(*keys, grid.column, *present(df, BASE_COLUMNS))
    chunked = cut(
        keep, grid, back=HOURLY_REACH, ahead=LABEL_REACH if include_targets else 0, keys=keys
    )
    return hourly_training_frame_of(chunked, include_targets, drop_unlabelled)


def daily_training_frame(
    df: DataFrame, keys=KEYS, grid: Grid = DAILY_GRID, keep_chunks: bool = False
) -> DataFrame:
    """Daily AQI, measures, lags, rolling statistics, calendar and three labels.

    With ``keep_chunks`` rows keep their chunk, for a split that follows at once.
    """
    if DAILY_AQI not in df.columns:
        raise KeyError(f"the daily table has no {DAILY_AQI!r} column")
    measures = present(df, BASE_COLUMNS)
    keep = df.select(*keys, grid.column, DAILY_AQI, *measures)
    chunked = cut(keep, grid, back=DAILY_REACH, ahead=DAILY_LABEL_REACH, keys=keys)
    windows = with_daily_lags(chunked.guarded()).then(
        lambda c: c.df.withColumns(daily_lag_roll_columns(c) | daily_target_columns(c))
    )
    columns = [
        DAILY_AQI,
        *daily_feature_columns(measures),
        *[f"target_{h}d" for h in DAILY_HORIZONS],
    ]
    frame = add_daily_calendar(windows.result(keep_chunks), grid.column)
    held = [CHUNK] if keep_chunks else []
    return frame.select(*keys, grid.column, *held, *columns).dropna(subset=columns)


def latest_window(
    df: DataFrame,
    as_of,
    hours_back: int = 168,
    fresh: DataFrame | None = None,
    drop_incomplete: bool = False,
    keys=KEYS,
) -> DataFrame:
    """The last ``hours_back`` rows of each series up to the hour of ``as_of``.

    A series whose last row is more than an hour old is read from ``fresh``
    instead. ``drop_incomplete`` first removes rows with a missing observation.
    """
    now = hour_floor(F.lit(as_of).cast("timestamp_ntz"))

    def recent(rows: DataFrame) -> DataFrame:
        if drop_incomplete:
            rows = rows.dropna(subset=present(rows, BASE_COLUMNS))
        return last_rows(rows.where(F.col(TIME) <= now), hours_back, keys)

    stored = recent(df)
    if fresh is None:
        return stored
    stale = (
        stored.groupBy(*keys)
        .agg(F.max(TIME).alias("_latest"))
        .where(F.col("_latest") < now - hours(1))
        .select(*keys)
    )
    return stored.join(stale, list(keys), "left_anti").unionByName(
        recent(fresh).join(stale, list(keys), "left_semi")
    )
