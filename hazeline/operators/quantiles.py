"""Exact quantiles per series in bounded memory.

``percentile`` keeps every distinct value of a group. Here a mergeable sketch of fixed size brackets each wanted
rank, and counting finds what lies below, on and between the two ends of the bracket. The rank is then on an end
or in an open interval with about a hundredth of the rows, which is bracketed in turn; an interval with few rows
is sorted. A sketch that misses costs a round and never the result, since only counts decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.schema import KEYS
from hazeline.session import shared_folder

COLUMN, VALUE, ROWS = "column", "_value", "_rows"
# Ranks at which a sketch is read; its own error is a fraction of one step.
GRID = 256
SKETCH = 2048
# Rows of an interval that are sorted in one row.
FEW = 10_000
_SIDES = ("below", "inside", "above")


def long_values(df: DataFrame, columns, keys=KEYS) -> DataFrame:
    """(keys, column, _value): one row per row and column; null and NaN are both missing."""
    pairs = [
        F.struct(F.lit(c).alias(COLUMN), F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(VALUE))
        for c in columns
    ]
    return df.select(*keys, F.inline(F.array(*pairs)))


def measures(df: DataFrame, columns, keys=KEYS) -> DataFrame:
    """Keys and columns as doubles; null and NaN are both missing."""
    return df.select(*keys, *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(c) for c in columns])


def _sketch(condition: str | None = None) -> Column:
    only = f" FILTER (WHERE {condition})" if condition else ""
    return F.expr(f"kll_sketch_agg_double({VALUE}, {SKETCH}){only}")


def _land(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sketched(values: DataFrame, *extra: Column, keys=KEYS) -> DataFrame:
    """Count and sketch of each series and column, and further aggregates of ``_value``, from one pass."""
    return _land(
        values.groupBy(*keys, COLUMN).agg(F.count(VALUE).alias("n"), _sketch().alias("sketch"), *extra)
    )


def _bracketed(targets: DataFrame) -> DataFrame:
    """Ends ``a`` and ``b`` of a bracket around each rank; null where the interval is small enough to sort."""
    ranks = ", ".join(f"{i / GRID!r}D" for i in range(GRID + 1))
    marks = F.expr(f"CASE WHEN n > {FEW} THEN kll_sketch_get_quantile_double(sketch, array({ranks})) END")
    step = F.floor((F.col("rank") + 0.5) / F.col("n") * GRID).cast("int")
    low, high = F.greatest(step - 1, F.lit(0)), F.least(step + 2, F.lit(GRID))
    return targets.withColumn("_marks", marks).select(
        *[c for c in targets.columns if c != "sketch"],
        F.get("_marks", low).alias("a"),
        F.get("_marks", high).alias("b"),
    )


def _narrowed(values: DataFrame, targets: DataFrame, keys) -> DataFrame:
    """One pass over the values: each rank's value where it shows, else a smaller interval with its sketch."""
    on = [*keys, COLUMN]
    places = [*on, "share", "upper", "rank", "n", "lo", "hi", "a", "b"]
    rows = values.where(f"{VALUE} IS NOT NULL").alias("v").join(
        _bracketed(targets).alias("t"),
        [F.col(f"v.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in on]
        + [F.expr(f"(t.lo IS NULL OR v.{VALUE} > t.lo) AND (t.hi IS NULL OR v.{VALUE} < t.hi)")],
    ).select("t.*", f"v.{VALUE}")
    sides = dict(zip(_SIDES, (f"{VALUE} < a", f"{VALUE} > a AND {VALUE} < b", f"{VALUE} > b"), strict=True))
    counted = rows.groupBy(*places).agg(
        F.expr(f"sort_array(collect_list({VALUE}) FILTER (WHERE a IS NULL))").alias("few"),
        F.expr(f"count_if({VALUE} = a)").alias("on_a"),
        F.expr(f"count_if({VALUE} = b AND b > a)").alias("on_b"),
        *[F.expr(f"count_if({side})").alias(f"n_{name}") for name, side in sides.items()],
        *[_sketch(side).alias(f"s_{name}") for name, side in sides.items()],
    )
    counted = counted.withColumns(
        {
            "_a": F.col("n_below"),
            "_in": F.expr("n_below + on_a"),
            "_b": F.expr("n_below + on_a + n_inside"),
            "_up": F.expr("n_below + on_a + n_inside + on_b"),
        }
    )
    found = """CASE WHEN a IS NULL THEN few[int(rank)] WHEN rank >= _a AND rank < _in THEN a
        WHEN rank >= _b AND rank < _up THEN b END"""
    part = "CASE WHEN rank < _a THEN {} WHEN rank < _b THEN {} ELSE {} END"
    return counted.select(
        *on, "share", "upper",
        F.expr(part.format("rank", "rank - _in", "rank - _up")).alias("rank"),
        F.expr(part.format("n_below", "n_inside", "n_above")).alias("n"),
        F.expr(part.format("lo", "a", "b")).alias("lo"),
        F.expr(part.format("a", "b", "hi")).alias("hi"),
        F.expr(part.format("s_below", "s_inside", "s_above")).alias("sketch"),
        F.expr(found).alias("found"),
    )


def exact_quantiles(values: DataFrame, sketches: DataFrame, shares, keys=KEYS) -> DataFrame:
    """(keys, column, quantiles): interpolated like ``percentile``; null where a column has no value.

    ``values`` comes from :func:`long_values` and ``sketches`` from :func:`sketched`. Rounds follow the logarithm
    of a series' rows: one round up to 10,000 rows, two up to about a million.
    """
    on = [*keys, COLUMN]
    position = F.expr("(n - 1) * share")
    wanted = sketches.where("n > 0").select(*on, "n", "sketch", F.explode(F.array(*map(F.lit, map(float, shares)))).alias("share"))
    pending = wanted.select(
        *on, "share", F.explode(F.array(F.lit(False), F.lit(True))).alias("upper"), "n", "sketch"
    ).withColumn("rank", F.when(F.col("upper"), F.ceil(position)).otherwise(F.floor(position)))
    nothing = F.lit(None).cast("double")
    pending = pending.where("NOT upper OR rank > (n - 1) * share").withColumns({"lo": nothing, "hi": nothing})
    settled = None
    while settled is None or not pending.isEmpty():
        step = _land(_narrowed(values, pending, keys))
        done = step.where("found IS NOT NULL").select(*on, "share", "upper", "found")
        settled = done if settled is None else settled.unionByName(done)
        pending = step.where("found IS NULL").drop("found")
    ends = settled.groupBy(*on, "share").agg(
        F.max(F.when(~F.col("upper"), F.col("found"))).alias("low"), F.max(F.when(F.col("upper"), F.col("found"))).alias("high")
    )
    between = F.expr(
        "CASE WHEN high IS NULL OR high = low THEN low "
        "ELSE (ceil((n - 1) * share) - (n - 1) * share) * low + ((n - 1) * share - floor((n - 1) * share)) * high END"
    )
    sized = sketches.select(*[F.col(c).alias(f"_{c}") for c in on], "n")
    same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in on]
    one = sized.join(ends, same, "left").withColumn("q", between)
    quantiles = [F.max(F.when(F.col("share") == float(s), F.col("q"))) for s in shares]
    return one.groupBy(*[F.col(f"_{c}").alias(c) for c in on]).agg(F.array(*quantiles).alias("quantiles"))


def _sorted_quantiles(values: DataFrame, columns, shares, keys) -> DataFrame:
    """(keys, column, quantiles) of series with few rows, from their sorted values."""
    held = values.groupBy(*keys).agg(*[F.sort_array(F.collect_list(f"`{c}`")).alias(f"_v{i}") for i, c in enumerate(columns)])

    def at(array: str, share: float) -> str:
        place = f"((size({array}) - 1) * {share!r}D)"
        low, high = (f"{array}[int({end}({place}))]" for end in ("floor", "ceil"))
        between = f"(ceil({place}) - {place}) * {low} + ({place} - floor({place})) * {high}"
        return f"CASE WHEN size({array}) > 0 THEN CASE WHEN {low} = {high} THEN {low} ELSE {between} END END"

    entries = [
        F.struct(F.lit(c).alias(COLUMN), F.array(*[F.expr(at(f"_v{i}", s)) for s in shares]).alias("quantiles"))
        for i, c in enumerate(columns)
    ]
    return held.select(*keys, F.inline(F.array(*entries)))


def quantiles_by_size(values: DataFrame, sizes: DataFrame, columns, shares, keys=KEYS) -> DataFrame:
    """(keys, column, quantiles): of series with up to FEW rows from their sorted values, of others by sketches.

    ``values`` comes from :func:`measures` and ``sizes`` has the rows of each series; both are read several times
    and should be stored.
    """
    shares = [float(s) for s in shares]
    large = sizes.where(F.col(ROWS) > FEW).select(*keys)
    if large.isEmpty():
        return _sorted_quantiles(values, columns, shares, keys)
    same = [F.col(f"v.`{k}`").eqNullSafe(F.col(f"l.`{k}`")) for k in keys]
    few = values.alias("v").join(large.alias("l"), same, "left_anti")
    many = long_values(values.alias("v").join(large.alias("l"), same, "left_semi"), columns, keys)
    return _sorted_quantiles(few, columns, shares, keys).unionByName(
        exact_quantiles(many, sketched(many, keys=keys), shares, keys)
    )
