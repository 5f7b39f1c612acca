"""Cadence, completeness and range checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions.common import any_null, hour_floor
from hazeline.operators.chunks import DAILY_GRID, HOURLY_GRID, Grid
from hazeline.operators.quantiles import ROWS, measures, quantiles_by_size
from hazeline.schema import KEYS, PROVIDER, TIME
from hazeline.session import stored


def _unpivot(df: DataFrame, keys, columns, name: str, value: str) -> DataFrame:
    return df.unpivot(list(keys), [F.col(f"`{c}`") for c in columns], name, value)


# Steps in one bitmap, as many as Spark's bitmap functions hold (4 KB).
BITS = 32_768


def _bit(grid: Grid) -> tuple:
    """Bucket and place of a step in the bitmaps of a series."""
    steps = grid.steps()
    return F.floor(steps / F.lit(BITS)).cast("bigint"), F.pmod(steps, F.lit(BITS).cast("bigint"))


def cadence_report(df: DataFrame, grid: Grid, keys=KEYS, facts=None) -> DataFrame:
    """Rows, distinct steps, span, duplicates and missing steps per series.

    Steps are marked in bitmaps, one of 4 KB for each 32,768 steps of a series, so that no list of
    times is shuffled. Times off the step are marked apart for each offset inside it. ``facts``
    are further aggregates of the same pass, given as name: (aggregate, aggregate over parts).
    """
    time = F.col(grid.column)
    facts = facts or {}
    if grid.step == "day":
        offset = F.lit(0)
        length = F.datediff(F.max("last"), F.min("first")).cast("bigint")
    else:
        offset = F.extract(F.lit("MINUTE"), time) * 60 + F.extract(F.lit("SECOND"), time)
        length = grid.steps(F.max("last")) - grid.steps(F.min("first"))
    bucket, place = _bit(grid)
    parts = df.groupBy(*keys, offset.alias("_offset"), bucket.alias("_bucket")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(time.isNull()).alias("invalid"),
        F.min(time).alias("first"),
        F.max(time).alias("last"),
        F.bitmap_count(F.bitmap_construct_agg(place)).alias("distinct_steps"),
        *[part.alias(name) for name, (part, _) in facts.items()],
    )
    offsets = F.when(F.col("last").isNotNull(), F.col("_offset"))
    report = parts.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("distinct_steps").alias("distinct_steps"),
        F.sum("invalid").alias("invalid"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        (length + 1).alias("expected_steps"),
        F.coalesce(F.min(offsets) == F.max(offsets), F.lit(True)).alias("aligned"),
        *[merge(name).alias(name) for name, (_, merge) in facts.items()],
    )
    return report.withColumns(
        {
            "duplicates": F.col("n_rows") - F.col("invalid") - F.col("distinct_steps"),
            "missing_steps": F.greatest(F.col("expected_steps") - F.col("distinct_steps"), F.lit(0)),
        }
    ).withColumn(
        "complete",
        (F.col("invalid") == 0)
        & (F.col("duplicates") == 0)
        & (F.col("expected_steps") == F.col("distinct_steps"))
        & F.col("aligned"),
    )


def validate_hourly_cadence(df: DataFrame, keys=KEYS) -> DataFrame:
    return cadence_report(df, HOURLY_GRID, keys)


def validate_daily_cadence(df: DataFrame, keys=KEYS) -> DataFrame:
    return cadence_report(df, DAILY_GRID, keys)


def _require_cadence(df: DataFrame, grid: Grid, keys) -> DataFrame:
    if grid.column not in df.columns:
        raise KeyError(f"the table has no {grid.column!r} column")
    bad = cadence_report(df, grid, keys).where(~F.col("complete")).limit(1).collect()
    if bad:
        row = bad[0]
        where = ", ".join(str(row[k]) for k in keys)
        if row["invalid"]:
            raise ValueError(f"series {where}: invalid timestamps")
        if row["duplicates"]:
            raise ValueError(f"series {where}: duplicate timestamps")
        raise ValueError(f"series {where}: not a complete {grid.step} cadence")
    return df


def require_hourly_cadence(df: DataFrame, keys=KEYS) -> DataFrame:
    """Fail unless every series has each hour of its span exactly once."""
    return _require_cadence(df, HOURLY_GRID, keys)


def require_daily_cadence(df: DataFrame, keys=KEYS) -> DataFrame:
    return _require_cadence(df, DAILY_GRID, keys)


def missing_steps(df: DataFrame, grid: Grid = HOURLY_GRID, keys=KEYS) -> DataFrame:
    """One row per step that a series lacks inside its span.

    Bitmaps tell which buckets lack any step, and only those are unfolded, bucket by bucket; a bucket
    without any row has no bitmap.
    """
    keys, time = list(keys), grid.column
    bucket, place = _bit(grid)
    steps = grid.steps()
    marked = (
        df.where(F.col(time).isNotNull())
        .groupBy(*keys, bucket.alias("_bucket"))
        .agg(F.bitmap_construct_agg(place).alias("_map"), F.min(steps).alias("_a"), F.max(steps).alias("_b"))
    )
    span = marked.groupBy(*keys).agg(F.min("_a").alias("_lo"), F.max("_b").alias("_hi"))
    buckets = F.sequence(F.floor(F.col("_lo") / BITS), F.floor(F.col("_hi") / BITS))
    expected = span.withColumn("_bucket", F.explode(buckets)).withColumns(
        {
            "_from": F.greatest(F.col("_lo"), F.col("_bucket") * BITS),
            "_to": F.least(F.col("_hi"), (F.col("_bucket") + 1) * BITS - 1),
        }
    )
    same = [F.col(f"e.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in [*keys, "_bucket"]]
    lacking = (
        expected.alias("e")
        .join(marked.alias("m"), same, "left")
        .where("_map IS NULL OR bitmap_count(_map) <= _to - _from")
        .select(*[F.col(f"e.`{c}`") for c in keys], "_map", F.explode(F.sequence("_from", "_to")).alias("_step"))
        .withColumn("_place", F.expr(f"int(pmod(_step, {BITS}))"))
        .withColumn("_byte", F.expr("int(conv(hex(substring(_map, _place DIV 8 + 1, 1)), 16, 10))"))
        .where("_map IS NULL OR shiftright(_byte, _place % 8) % 2 = 0")
    )
    if grid.step == "day":
        value = F.date_from_unix_date(F.col("_step").cast("int"))
    else:
        value = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.col("_step").cast("int")
        )
    return lacking.select(*keys, value.alias(time))


def gap_report(df: DataFrame, keys=KEYS) -> DataFrame:
    """Duplicates, expected hours and missing hours per series."""
    report = cadence_report(df.withColumn(TIME, hour_floor(F.col(TIME))), HOURLY_GRID, keys)
    return report.select(
        *keys,
        "duplicates",
        F.col("expected_steps").alias("expected_hours"),
        F.col("missing_steps").alias("missing_hours"),
    )


def missing_value_report(df: DataFrame, keys=KEYS) -> DataFrame:
    """Null count per series and column."""
    columns = [c for c in df.columns if c not in keys]
    counts = df.groupBy(*keys).agg(*[F.expr(f"count_if(`{c}` IS NULL)").alias(c) for c in columns])
    return _unpivot(counts, keys, columns, "column", "missing")


def completeness(df: DataFrame, columns, keys=KEYS) -> DataFrame:
    """Rows and rows with a missing observation per series."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null(columns)).alias("incomplete_rows")
    )


def require_complete(df: DataFrame, columns, keys=KEYS) -> DataFrame:
    if df.where(any_null(columns)).limit(1).count():
        raise ValueError(f"missing observed values in {', '.join(columns)}")
    return df


def range_report(df: DataFrame, columns=None, keys=KEYS) -> DataFrame:
    """Negative count, minimum, median and maximum per series and numeric column.

    The median is exact and its state bounded, whatever a series holds (``quantiles``). The values are stored first,
    as counts decide which series are sorted and which need rounds.
    """
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in keys
    ]
    columns = numeric if columns is None else [c for c in columns if c in numeric]
    values = stored(measures(df, columns, keys), "ranges")
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.col(f"`{c}`") < 0).alias("negative"),
            F.min(f"`{c}`").alias("min"),
            F.max(f"`{c}`").alias("max"),
        )
        for c in columns
    ]
    rows = F.count(F.lit(1)).alias(ROWS)
    facts = stored(values.groupBy(*keys).agg(rows, F.array(*stats).alias("_facts")), "ranges")
    medians = quantiles_by_size(values, facts.select(*keys, ROWS), columns, [0.5], keys)
    long = facts.select(*keys, F.inline("_facts"))
    same = [F.col(f"s.`{c}`").eqNullSafe(F.col(f"m.`{c}`")) for c in [*keys, "column"]]
    return long.alias("s").join(medians.alias("m"), same).select(
        *[F.col(f"s.`{c}`") for c in [*keys, "column"]], "negative", "min", F.col("quantiles")[0].alias("median"), "max"
    )


def _product_facts(df: DataFrame, keys, name: str) -> DataFrame:
    """One row of facts per series of one raw product."""
    columns = [c for c in df.columns if c not in (*keys, "requested_end")]
    measures = [c for c in columns if c not in (TIME, "source")]
    source_ok = F.col("source").isNull() | F.col("source").startswith(f"{PROVIDER}_")
    nulls = F.lit(0)
    for c in [*measures, "source"]:
        nulls = nulls + F.col(c).isNull().cast("int")
    requested = (
        F.max("requested_end") if "requested_end" in df.columns else F.to_date(F.max(TIME))
    )
    facts = {
        "missing_cells": (F.sum(nulls), F.sum),
        "source_ok": (F.every(source_ok), F.every),
        "requested_end": (requested, F.max),
    }
    report = cadence_report(df, HOURLY_GRID, keys, facts)
    return report.select(*keys, "n_rows", "first", "last", "complete", *facts).withColumns(
        {"product": F.lit(name), "n_columns": F.lit(len(columns))}
    )


def _checked_products(air: DataFrame, weather: DataFrame, start, keys) -> DataFrame:
    """Facts of both products of a series as ``a`` and ``w``, the contract and whether all is clean."""

    def facts(df: DataFrame, product: str, name: str) -> DataFrame:
        rows = _product_facts(df, keys, product)
        return rows.select(*keys, F.struct(*[c for c in rows.columns if c not in keys]).alias(name))

    begin = F.lit(start).cast("timestamp_ntz")
    contract = (
        (F.col("a.first") == begin)
        & (F.col("w.first") == begin)
        & (F.col("a.last") == F.col("w.last"))
        & (F.col("a.requested_end") == F.to_date("a.last"))
        & (F.col("w.requested_end") == F.to_date("w.last"))
        & F.col("a.source_ok")
        & F.col("w.source_ok")
    )
    clean = (
        F.col("a.complete")
        & F.col("w.complete")
        & (F.col("a.missing_cells") == 0)
        & (F.col("w.missing_cells") == 0)
    )
    both = facts(air, "aqi_training", "a").join(facts(weather, "weather_features", "w"), list(keys))
    return both.withColumn("contract", F.coalesce(contract, F.lit(False))).withColumn(
        "clean", F.coalesce(clean, F.lit(False))
    )


def raw_contract_check(air: DataFrame, weather: DataFrame, start, keys=KEYS) -> DataFrame:
    """PASS or REVIEW per series: start, common end, requested end, source labels
    (the contract), then no duplicates, gaps or missing cells (the verdict)."""

    def verdict(ok):
        return F.when(ok, "PASS").otherwise("REVIEW")

    checked = _checked_products(air, weather, start, keys)
    return checked.select(
        *keys,
        verdict(F.col("contract")).alias("contract"),
        verdict(F.col("contract") & F.col("clean")).alias("verdict"),
    )


def qc_summary(air: DataFrame, weather: DataFrame, start, keys=KEYS) -> DataFrame:
    """Rows, columns, span, missing cells and contract per series and product; reads each product once."""
    rows = _checked_products(air, weather, start, keys).select(
        *keys, "contract", F.explode(F.array("a", "w")).alias("p")
    )
    return rows.select(
        *keys,
        "p.product",
        "p.n_rows",
        "p.n_columns",
        F.col("p.first").alias("start"),
        F.col("p.last").alias("end"),
        "p.missing_cells",
        F.col("contract").alias("contract_pass"),
    )


def live_check(air: DataFrame, weather: DataFrame, zone: str, keys=KEYS) -> DataFrame:
    """PASS per series when both live products carry ``zone`` and lack no value."""

    def good(df: DataFrame, name: str) -> DataFrame:
        values = [c for c in df.columns if c not in (*keys, "timezone")]
        ok = F.col("timezone").eqNullSafe(F.lit(zone)) & ~any_null(values)
        return df.groupBy(*keys).agg(F.every(ok).alias(name))

    both = good(air, "_air").join(good(weather, "_weather"), list(keys), "full")
    ok = F.coalesce(F.col("_air") & F.col("_weather"), F.lit(False))
    return both.select(*keys, F.when(ok, "PASS").otherwise("REVIEW").alias("verdict"))
