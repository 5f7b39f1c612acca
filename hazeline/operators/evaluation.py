"""Forecast metrics, the release gate and model selection.

Metrics are finished from additive statistics, so one pass of map-side
aggregation per (series, model, output) serves outputs and output groups.
Tasks form them for whole Arrow batches; Spark adds up what the batches give.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.aqi import CATEGORIES, HIGH_AQI
from hazeline.operators.baselines import prediction
from hazeline.schema import KEYS, OUTPUTS

# Executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS = range(len(CATEGORIES))


INDEX = "output_index"
_NAMES = ", ".join(f"'{name}'" for name, *_ in OUTPUTS)
_GROUPS = ", ".join(f"'{group}'" for _, group, *_ in OUTPUTS)


def to_cells(df: DataFrame, models, keep=KEYS) -> DataFrame:
    """One row per model with the observed outputs ``_y`` and the predicted ones ``_p`` as arrays."""

    def values(names) -> str:
        return f"array({', '.join(names)})"

    names = [name for name, *_ in OUTPUTS]
    forecasts = ", ".join(
        f"named_struct('model', '{m}', '_p', {values(prediction(m, n) for n in names)})"
        for m in models
    )
    return df.selectExpr(*keep, f"{values(names)} AS _y", f"inline(array({forecasts}))")


def to_long(df: DataFrame, models, keep=KEYS) -> DataFrame:
    """One row per model and output with the observed ``y`` and the predicted ``yhat``.

    Outputs are numbered from 0, which keeps the rows to be aggregated small.
    """
    return (
        to_cells(df, models, keep)
        .selectExpr("*", f"explode(sequence(0, {len(OUTPUTS) - 1})) AS {INDEX}")
        .selectExpr(*keep, "model", INDEX, f"_y[{INDEX}] AS y", f"_p[{INDEX}] AS yhat")
    )


def name_outputs(df: DataFrame) -> DataFrame:
    """Replace the output number by the output's name and group."""
    return df.withColumns(
        {
            "output": F.expr(f"array({_NAMES})[{INDEX}]"),
            "group": F.expr(f"array({_GROUPS})[{INDEX}]"),
        }
    ).drop(INDEX)


_CATEGORY_COUNTS = ["_same", "_high", "_high_hit", *[f"{kind}{b}" for b in BANDS for kind in ("_hit", "_true", "_guess")]]
_SUMS = ["_se", "_ae", "_s", "_q", "_d", "_lo", "_hi"]
# Rows whose groups a task holds at once.
_BLOCK = 2048


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of doubles or of arrays of doubles, a row each, and which are not null."""
    rows = len(column)
    values = column.flatten() if pa.types.is_list(column.type) else column
    known = values.is_valid().to_numpy(zero_copy_only=False)
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1), known.reshape(rows, -1)


def _bands(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Number of each value's category as :func:`band_sql` has it; one more than the last for none."""
    whole = np.rint(values)
    band = np.zeros(values.shape, np.int8)
    for high, _ in CATEGORIES[:-1]:
        band += ~(whole <= high)
    band[~known | (whole < 0)] = len(CATEGORIES)
    return band


def _group_rows(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by group, and of each group where it begins there and one of its rows."""
    code = np.zeros(len(columns[0]) if columns else 0, np.int64)
    for column in columns:
        own = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        code = np.unique(code * (int(own.max()) + 1) + own, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    begins = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, begins, order[begins]


def _block_statistics(y, known, yhat, guessed, order, begins, parts) -> dict[str, pa.Array]:
    """Statistics of each group and output of a block; a sum over nothing is masked by its count.

    ``parts`` says whether errors are needed, and whether counts of categories are.
    """
    y, known, yhat, guessed = (m[order] for m in (y, known, yhat, guessed))
    groups, width = len(begins), y.shape[1]
    sizes = np.diff(begins, append=len(order))

    def total(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, begins, axis=0)

    errors, categories = parts
    nan = np.isnan(y)
    out, masks = {"_n": np.repeat(sizes, width).reshape(groups, width)}, {}
    if errors:
        out |= _error_sums(y, known, yhat, guessed, nan, sizes, begins, total)
        masks = {"_se": out["_pairs"] == 0, "_ae": out["_pairs"] == 0}
        masks |= {c: out["_c"] == 0 for c in ("_s", "_q", "_d", "_lo", "_hi")}
    if categories:
        high = known & ((y >= HIGH_AQI) | nan)
        out["_high"] = total(high.astype(np.int64))
        out["_high_hit"] = total((high & guessed & ((yhat >= HIGH_AQI) | np.isnan(yhat))).astype(np.int64))
        kinds = len(CATEGORIES) + 1
        pair = _bands(y, known) * kinds + _bands(yhat, guessed)
        place = np.repeat(np.arange(groups), sizes)[:, None] * width + np.arange(width)
        cell = place * (kinds * kinds) + pair
        table = np.bincount(cell.ravel(), minlength=groups * width * kinds * kinds).reshape(groups, width, kinds, kinds)
        out["_same"] = np.trace(table, axis1=2, axis2=3)
        for b in BANDS:
            out |= {f"_hit{b}": table[:, :, b, b], f"_true{b}": table[:, :, b].sum(axis=2), f"_guess{b}": table[..., b].sum(axis=2)}
    return {c: pa.array(out[c].ravel(), mask=masks[c].ravel() if c in masks else None) for c in sum(_names(parts), [])}


def _names(parts) -> tuple[list[str], list[str]]:
    """Statistics that are whole numbers, and the others."""
    errors, categories = parts
    return ["_n"] + ["_c"] * errors + _CATEGORY_COUNTS * categories, _SUMS * errors


def _error_sums(y, known, yhat, guessed, nan, sizes, begins, total) -> dict[str, np.ndarray]:
    both = known & guessed
    error = np.where(both, yhat - y, 0.0)
    number = known & ~nan
    held = np.where(known, y, 0.0)
    out = {"_c": total(known.astype(np.int64)), "_pairs": total(both.astype(np.int64))}
    out["_s"] = total(held)
    filled = np.maximum(out["_c"], 1)
    apart = np.where(known, y - np.repeat(out["_s"] / filled, sizes, axis=0), 0.0)
    out |= {"_se": total(error * error), "_ae": total(np.abs(error)), "_d": total(apart * apart)}
    out["_q"] = out["_s"] * out["_s"] / filled
    # As in Spark, not-a-number is above every number.
    least = np.minimum.reduceat(np.where(number, y, np.inf), begins, axis=0)
    out["_lo"] = np.where(total(number.astype(np.int64)) > 0, least, np.nan)
    out["_hi"] = np.maximum.reduceat(np.where(known, y, -np.inf), begins, axis=0)
    return out


def _statistics_by(df: DataFrame, by, parts=(True, True)) -> DataFrame:
    """Statistics per group of rows of :func:`to_long` or of :func:`to_cells`, which have an index of their own."""
    whole, sums = _names(parts)
    wide = "_y" in df.columns
    heads = [c for c in by if not (wide and c == INDEX)]
    values = ["_y", "_p"] if wide else ["y", "yhat"]
    kind = "array<double>" if wide else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), _BLOCK):
                some = batch.slice(begin, _BLOCK)
                columns = [some.column(i) for i in range(len(heads))]
                y, known = _matrix(some.column(len(heads)))
                yhat, guessed = _matrix(some.column(len(heads) + 1))
                order, begins, first = _group_rows(columns)
                if not columns:
                    order, begins = np.arange(len(some)), np.array([0])
                found = _block_statistics(y, known, yhat, guessed, order, begins, parts)
                which = pa.array(np.repeat(first, y.shape[1]))
                out = {c: column.take(which) for c, column in zip(heads, columns, strict=True)}
                if wide:
                    out[INDEX] = pa.array(np.tile(np.arange(y.shape[1], dtype=np.int32), len(begins)))
                yield pa.RecordBatch.from_pydict(out | found)

    schema = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in heads] + [f"{INDEX} int"] * wide
    schema += [f"{c} bigint" for c in whole] + [f"{c} double" for c in sums]
    rows = df.select(*heads, *[F.col(v).cast(kind).alias(v) for v in values])
    added = [F.sum(c).alias(c) for c in whole if c != "_c"]
    if sums:
        between = "sum(_q) - try_divide(sum(_s) * sum(_s), sum(_c))"
        added += [
            F.sum("_se").alias("_se"),
            F.sum("_ae").alias("_ae"),
            F.expr("try_divide(sum(_s), sum(_c)) AS _mean"),
            F.expr(f"sum(_d) + greatest({between}, 0D) AS _dev"),
            F.min("_lo").alias("_lo"),
            F.max("_hi").alias("_hi"),
        ]
    return rows.mapInArrow(run, ", ".join(schema)).groupBy(*by).agg(*added)


def _statistics_of(frames, by) -> DataFrame:
    """Statistics of one frame, or of several that share no group."""
    frames = [frames] if isinstance(frames, DataFrame) else list(frames)
    found = _statistics_by(frames[0], by)
    for df in frames[1:]:
        found = found.unionByName(_statistics_by(df, by))
    return found


def _pool(stats: DataFrame, by) -> DataFrame:
    """Combine statistics of several outputs into those of their union."""
    added = [c for c in stats.columns if c not in by and c.startswith("_")]
    added = [c for c in added if c not in ("_mean", "_dev", "_lo", "_hi")]
    between = "sum(_n * _mean * _mean) - sum(_n * _mean) * sum(_n * _mean) / sum(_n)"
    return stats.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in added],
        F.expr(f"sum(_dev) + {between} AS _dev"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
    )


REGRESSION_SQL = {
    "mse": "_se / _n",
    "rmse": "sqrt(_se / _n)",
    "mae": "_ae / _n",
    # A constant observation has no variance to explain.
    "r2": "CASE WHEN _lo <> _hi THEN 1D - try_divide(_se, _dev) WHEN _se = 0 THEN 1D ELSE 0D END",
}
_F1 = " + ".join(f"coalesce(try_divide(2D * _hit{b}, _true{b} + _guess{b}), 0D)" for b in BANDS)
CATEGORY_SQL = {
    "category_accuracy": "_same / _n",
    "category_macro_f1": f"({_F1}) / {len(BANDS)}D",
    "high_aqi_recall": "coalesce(try_divide(double(_high_hit), _high), 0D)",
}


def _finish(stats: DataFrame, by, metrics: dict[str, str]) -> DataFrame:
    return stats.selectExpr(
        *[f"`{c}`" for c in by], *[f"{sql} AS {name}" for name, sql in metrics.items()]
    )


def regression_metrics(df: DataFrame, by=(*KEYS, "model", INDEX)) -> DataFrame:
    """mse, rmse, mae and r2 of ``yhat`` against ``y``.

    With a constant ``y``, r2 is 1 without any error and 0 otherwise.
    """
    return _finish(_statistics_by(df, by, (True, False)), by, REGRESSION_SQL)


def category_metrics(df: DataFrame, by=(*KEYS, "model", INDEX)) -> DataFrame:
    """Category accuracy, macro F1 over all six bands, and recall of AQI 101 and above."""
    return _finish(_statistics_by(df, by, (False, True)), by, CATEGORY_SQL)


ALL_SQL = {**REGRESSION_SQL, **CATEGORY_SQL}


def evaluate_outputs(df, keys=KEYS) -> DataFrame:
    """All metrics per model and output, plus rows with output ``all`` that pool a group.

    ``df`` is a frame, or several that hold different models.
    """
    by = [*keys, "model", "group"]
    stats = name_outputs(_statistics_of(df, [*keys, "model", INDEX]))
    pooled = _pool(stats, by).withColumn("output", F.lit("all"))
    columns = [*by, "output"]
    return _finish(stats, columns, ALL_SQL).unionByName(_finish(pooled, columns, ALL_SQL))


def evaluate_folds(df, keys=KEYS) -> DataFrame:
    """All metrics per fold, model and output; ``df`` as in :func:`evaluate_outputs`, or models of different folds."""
    by = [*keys, "fold", "model"]
    stats = name_outputs(_statistics_of(df, [*by, INDEX]))
    return _finish(stats, [*by, "group", "output"], ALL_SQL)


def rolling_origin_evaluation(per_fold: DataFrame, keys=KEYS) -> DataFrame:
    """Mean of the per-fold, per-output metrics by model and group (no pooling)."""
    return per_fold.groupBy(*keys, "model", "group").agg(*[F.avg(m).alias(m) for m in ALL_SQL])


def release_gate(
    grouped: DataFrame, candidates=("ridge", "xgboost"), baseline: str = "persistence", keys=KEYS
) -> DataFrame:
    """Whether the best candidate beats the baseline on mean RMSE and on mean MAE.

    The best has the lowest RMSE averaged over groups. Groups it beats are only
    reported. A series without candidates or baseline fails the job.
    """
    keys = list(keys)
    rows = grouped.where(F.col("model").isin(*candidates, baseline))
    means = rows.groupBy(*keys, "model").agg(
        F.avg("rmse").alias("rmse"),
        F.avg("mae").alias("mae"),
        F.map_from_entries(F.collect_list(F.struct("group", "rmse"))).alias("by_group"),
    )
    is_base = F.col("model") == baseline
    entry = F.struct("model", "rmse", "mae", "by_group")
    picked = means.groupBy(*keys).agg(
        F.min_by(F.when(~is_base, entry), F.when(~is_base, F.struct("rmse", "model"))).alias("b"),
        F.max(F.when(is_base, F.col("rmse"))).alias("base_rmse"),
        F.max(F.when(is_base, F.col("mae"))).alias("base_mae"),
        F.first(F.when(is_base, F.col("by_group")), ignorenulls=True).alias("base_by_group"),
    )
    beaten = F.size(
        F.filter(
            F.map_entries("b.by_group"),
            lambda e: e["value"] < F.try_element_at(F.col("base_by_group"), e["key"]),
        )
    )
    passed = (F.col("b.rmse") < F.col("base_rmse")) & (F.col("b.mae") < F.col("base_mae"))
    lost = F.format_string(
        "%s does not beat %s: RMSE %.2f vs %.2f, MAE %.2f vs %.2f",
        "b.model", F.lit(baseline), "b.rmse", "base_rmse", "b.mae", "base_mae",
    )
    won = F.format_string(
        "%s beats %s: RMSE %.2f < %.2f, MAE %.2f < %.2f, better in %d groups",
        "b.model", F.lit(baseline), "b.rmse", "base_rmse", "b.mae", "base_mae", "groups_beaten",
    )
    missing = F.col("b").isNull() | F.col("base_rmse").isNull()
    gate = F.when(missing, F.raise_error(F.lit("no candidate or no baseline in the evaluation")))
    return picked.withColumn("groups_beaten", beaten).select(
        *keys,
        gate.otherwise(passed).alias("pass"),
        F.col("b.model").alias("best_model"),
        F.col("b.rmse").alias("best_rmse"),
        F.col("base_rmse").alias("baseline_rmse"),
        F.col("b.mae").alias("best_mae"),
        F.col("base_mae").alias("baseline_mae"),
        "groups_beaten",
        F.when(passed, won).otherwise(lost).alias("reason"),
    )


def select_model_by_group(
    grouped: DataFrame, candidates=("ridge", "xgboost"), by=(*KEYS, "group"), default="ridge"
) -> DataFrame:
    """Candidate with the lowest RMSE per group (or horizon); ``default`` without any."""
    candidate = F.col("model").isin(*candidates)
    best = F.min_by("model", F.when(candidate, F.struct("rmse", "model")))
    return grouped.groupBy(*by).agg(F.coalesce(best, F.lit(default)).alias("model"))
