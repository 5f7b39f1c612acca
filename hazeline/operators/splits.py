"""Chronological splits and folds with an embargo, by position in the series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.common import fail_when
from hazeline.operators.chunks import HOURLY_GRID, Grid, with_positions
from hazeline.schema import KEYS, MAX_FORECAST_DAYS, MAX_FORECAST_HOURS


def least_gap(grid: Grid) -> int:
    """Hourly labels reach 72 hours ahead, and a split must leave that many out."""
    return MAX_FORECAST_HOURS if grid.step == "hour" else 0


def default_gap(grid: Grid) -> int:
    return MAX_FORECAST_HOURS if grid.step == "hour" else MAX_FORECAST_DAYS


def _check_gap(gap: int | None, grid: Grid) -> int:
    gap = default_gap(grid) if gap is None else gap
    if gap < least_gap(grid):
        raise ValueError(f"the gap must be at least {least_gap(grid)} {grid.step}s")
    return gap


def split_label(pos: Column, n: Column, test_fraction: float, gap: int) -> Column:
    split_at = F.floor(n * F.lit(1 - test_fraction))
    too_short = (split_at - gap <= 0) | (split_at >= n)
    label = (
        F.when(pos >= split_at, "test").when(pos < split_at - gap, "train").otherwise("purged")
    )
    return fail_when(too_short, "series too short for the requested split", label)


def chronological_split(
    df: DataFrame,
    test_fraction: float = 0.2,
    gap: int | None = None,
    grid: Grid = HOURLY_GRID,
    keys=KEYS,
) -> DataFrame:
    """Add ``split``: train, then ``gap`` purged rows, then the last fraction as test."""
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    gap = _check_gap(gap, grid)
    placed = with_positions(df, grid, keys, "_pos", "_n")
    label = split_label(F.col("_pos"), F.col("_n"), test_fraction, gap)
    return placed.withColumn("split", label).drop("_pos", "_n")


def _folds(
    df: DataFrame, test_size: Column, n_splits: int, gap: int, grid: Grid, keys, message: str
) -> DataFrame:
    """One row per fold a row belongs to, with its role in that fold."""
    placed = with_positions(df, grid, keys, "_pos", "_n").withColumn("_size", test_size)
    first = F.col("_n") - n_splits * F.col("_size")
    start = first + (F.col("fold") - 1) * F.col("_size")
    role = F.when(F.col("_pos") < start - gap, "train").when(
        (F.col("_pos") >= start) & (F.col("_pos") < start + F.col("_size")), "test"
    )
    return (
        placed.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
        .withColumn("role", fail_when(first - gap <= 0, message, role))
        .where(F.col("role").isNotNull())
        .drop("_pos", "_n", "_size")
    )


def rolling_origin_folds(
    df: DataFrame,
    n_splits: int = 3,
    test_size: int = 168,
    gap: int = MAX_FORECAST_HOURS,
    grid: Grid = HOURLY_GRID,
    keys=KEYS,
) -> DataFrame:
    """Expanding training windows, each followed by the gap and ``test_size`` test rows."""
    if n_splits < 2 or test_size <= 0:
        raise ValueError("need at least two folds of a positive test size")
    gap = _check_gap(gap, grid)
    message = "series too short for the requested folds"
    return _folds(df, F.lit(test_size), n_splits, gap, grid, keys, message)


def training_windows(
    pos: Column,
    n: Column,
    test_fraction: float = 0.2,
    n_splits: int = 3,
    test_size: int = 168,
    gap: int = MAX_FORECAST_HOURS,
) -> dict[str, Column]:
    """Which rows train the holdout fit and the fit of each rolling fold, by position in the series."""
    windows = {"holdout": split_label(pos, n, test_fraction, gap) == "train"}
    for fold in range(1, n_splits + 1):
        windows[f"fold_{fold}"] = pos < n - (n_splits + 1 - fold) * test_size - gap
    return windows


def purged_cv_folds(
    df: DataFrame,
    n_splits: int = 3,
    gap: int = MAX_FORECAST_HOURS,
    grid: Grid = HOURLY_GRID,
    keys=KEYS,
) -> DataFrame:
    """Time-series cross-validation: test blocks of a ``1/(n_splits+1)`` share each."""
    size = F.floor(F.col("_n") / F.lit(n_splits + 1))
    message = "series too short for cross-validation with this gap"
    return _folds(df, size, n_splits, gap, grid, keys, message)


