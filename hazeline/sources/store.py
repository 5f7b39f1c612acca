"""Feature store: Parquet batches and an append-only metadata table.

A write lands in a folder of its own and becomes visible with its metadata row,
which lists the batches of the table. A failed or repeated write therefore
leaves readers with the state before it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions.common import present
from hazeline.operators.features import daily_training_frame, hourly_training_frame
from hazeline.schema import (
    BASE_COLUMNS,
    DAILY_AQI,
    DAILY_HORIZONS,
    DATE,
    KEYS,
    TARGET_COLUMNS,
    TIME,
    daily_feature_columns,
    hourly_feature_columns,
)
from hazeline.session import shared_folder
from hazeline.sources.files import read_if_present

SCHEMA_VERSION = 1
COMPRESSION = "zstd"
# Between a batch's name and the attempt that wrote it.
ATTEMPT = "~"
TABLES = ("hourly_raw", "hourly_observations", "hourly_features", "daily_features")
META_SCHEMA = (
    "table_name string, schema_version int, feature_columns array<string>, "
    "target_columns array<string>, n_rows bigint, source_file string, source_sha256 string, "
    "created_at timestamp_ntz, batches array<string>, revision bigint, row_schema string"
)


def _meta(spark: SparkSession, root: str) -> DataFrame:
    rows = read_if_present(spark, f"{root}/meta", META_SCHEMA)
    newest = Window.partitionBy("table_name").orderBy(F.col("revision").desc())
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def _current(spark: SparkSession, root: str, table: str):
    """The table's metadata row, if it was ever written."""
    return _meta(spark, root).where(F.col("table_name") == table).first()


def time_column(df: DataFrame) -> str:
    return TIME if TIME in df.columns else DATE


def write_feature_table(
    df: DataFrame,
    root: str,
    table: str,
    features,
    targets=(),
    replace: bool = True,
    source: str = "",
    source_sha256: str = "",
    created_at: str = "1970-01-01 00:00:00",
    batch: str | None = None,
) -> None:
    """Write one batch, partitioned by year, and record it.

    A given ``batch`` name makes a retried append idempotent: the retry writes a
    folder of its own and takes the first one's place when it is complete.
    """
    spark = df.sparkSession
    known = _current(spark, root, table)
    batch = batch or uuid.uuid4().hex
    folder = f"{batch}{ATTEMPT}{uuid.uuid4().hex}"
    time = time_column(df)
    # Each task writes the rows it has, a file a year: frames come dealt out by series and time, and whole rows
    # would be shuffled for the sake of file sizes alone.
    (
        df.withColumn("year", F.year(time))
        .sortWithinPartitions("year", *present(df, KEYS), time)
        .write.mode("overwrite")
        .option("compression", COMPRESSION)
        .partitionBy("year")
        .parquet(f"{root}/{table}/batch={folder}")
    )
    held = [] if replace or known is None else list(known["batches"])
    old = [b for b in held if b.split(ATTEMPT)[0] != batch]
    fields = {f.name: f for f in df.schema}
    if old:
        fields = {f.name: f for f in _schema(known)} | fields
    row_schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()]).json()
    # Earlier batches were counted when they came; only a repeated one changes them.
    counted = [folder] if old == held else [*old, folder]
    n_rows = _rows(spark, root, table, counted, row_schema).count()
    n_rows += known["n_rows"] if old and old == held else 0
    row = (
        table, SCHEMA_VERSION, list(features), list(targets), n_rows, source, source_sha256,
        [*old, folder], (known["revision"] if known else 0) + 1, row_schema,
    )
    shape = META_SCHEMA.replace("created_at timestamp_ntz, ", "")
    meta = spark.createDataFrame([row], shape).withColumn(
        "created_at", F.lit(created_at).cast("timestamp_ntz")
    )
    meta.coalesce(1).write.mode("append").parquet(f"{root}/meta")


def _schema(known) -> T.StructType:
    return T.StructType.fromJson(json.loads(known["row_schema"]))


def _rows(spark: SparkSession, root: str, table: str, folders, row_schema: str) -> DataFrame:
    """Rows of some batches and their year: one scan, however many there are; empty ones are fine."""
    schema = T.StructType.fromJson(json.loads(row_schema)).add("year", T.IntegerType())
    reader = spark.read.schema(schema).option("basePath", f"{root}/{table}")
    return reader.parquet(*[f"{root}/{table}/batch={f}" for f in folders]).drop("batch")


def read_batches(
    spark: SparkSession, root: str, table: str, only: str | None = None, without: str | None = None
) -> DataFrame | None:
    """Rows of one named batch, or of all but one; None when there are no such batches."""
    known = _current(spark, root, table)
    names = [(b, b.split(ATTEMPT)[0]) for b in known["batches"]] if known else []
    folders = [b for b, name in names if name != without and only in (None, name)]
    return _rows(spark, root, table, folders, known["row_schema"]) if folders else None


def read_feature_table(
    spark: SparkSession, root: str, table: str, start=None, end=None
) -> DataFrame:
    """Rows of a table with time in ``[start, end]``; years and row groups outside are skipped."""
    known = _current(spark, root, table)
    if known is None:
        raise FileNotFoundError(f"feature store has no table {table!r}")
    rows = _rows(spark, root, table, known["batches"], known["row_schema"])
    return time_slice(rows, start, end).drop("year")


def time_slice(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with time in the inclusive range; a stored table is also cut by its year."""
    time = time_column(df)
    kind = df.schema[time].dataType.simpleString()
    for bound, keep in ((start, F.Column.__ge__), (end, F.Column.__le__)):
        if bound is None:
            continue
        limit = F.lit(str(bound)).cast(kind)
        df = df.where(keep(F.col(time), limit))
        if "year" in df.columns:
            df = df.where(keep(F.col("year"), F.year(limit)))
    return df


def read_latest(
    spark: SparkSession, root: str, table: str, as_of, rows: int, keys=KEYS
) -> DataFrame:
    """Rows of the days that hold the last ``rows`` rows of each series up to ``as_of``.

    A first pass counts rows a day from keys and time alone, and gives each series the day its rows begin.
    The second reads whole rows from the earliest of these days on, so years and row groups on either side
    are skipped, and of each series no more than its own days.
    """
    stored = read_feature_table(spark, root, table, end=as_of)
    time = time_column(stored)
    days = stored.groupBy(*keys, F.to_date(time).alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    newer = Window.partitionBy(*keys).orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    held = days.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0))).where(F.col("_newer") < rows)
    path = shared_folder(spark, "starts")
    starts = held.groupBy(*keys).agg(F.min("_day").alias("_from"))
    starts.write.parquet(path)
    starts = spark.read.schema(starts.schema).parquet(path)
    first = starts.agg(F.min("_from")).first()[0]
    recent = read_feature_table(spark, root, table, start=first, end=as_of)
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    return recent.alias("r").join(
        starts.alias("s"), [*same, F.col(f"r.`{time}`") >= F.col("s._from")]
    ).select("r.*")


def get_hourly_raw(spark, root, start=None, end=None) -> DataFrame:
    return read_feature_table(spark, root, "hourly_raw", start, end)


def get_hourly_observations(spark, root, start=None, end=None) -> DataFrame:
    return read_feature_table(spark, root, "hourly_observations", start, end)


def get_hourly_features(spark, root, start=None, end=None) -> DataFrame:
    return read_feature_table(spark, root, "hourly_features", start, end)


def get_daily_features(spark, root, start=None, end=None) -> DataFrame:
    return read_feature_table(spark, root, "daily_features", start, end)


def validate_feature_schema(spark, root: str, table: str, expected) -> None:
    """Fail when the stored feature columns differ from ``expected`` in name or order."""
    known = _current(spark, root, table)
    if known is None:
        raise ValueError(f"feature store has no metadata for table {table!r}")
    stored, expected = list(known["feature_columns"]), list(expected)
    if stored != expected:
        missing = sorted(set(expected) - set(stored))
        extra = sorted(set(stored) - set(expected))
        raise ValueError(f"schema drift on {table!r}: missing={missing} extra={extra}")


def table_stats(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of every stored table, by name."""
    return _meta(spark, root).drop("batches", "revision").orderBy("table_name")


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's content that ignores row order, from one aggregate."""
    parts = df.agg(
        F.count(F.lit(1)),
        F.bit_xor(F.xxhash64(*df.columns)),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")),
    ).first()
    return hashlib.sha256("|".join(map(str, [*df.columns, *parts])).encode()).hexdigest()


def backfill_hourly(
    spark, hourly: DataFrame, root: str, replace: bool = True, source: str = "", **meta
) -> DataFrame:
    """Store raw hours, features, and features with labels; return the tables' metadata.

    The frame with labels extends the observations by columns only, so its
    observation columns come from the stored observations.
    """
    measures = present(hourly, BASE_COLUMNS)
    features = hourly_feature_columns(measures)
    raw = hourly.select(*KEYS, TIME, *measures)
    info = {"source": source, "source_sha256": fingerprint(raw), "replace": replace, **meta}
    write_feature_table(raw, root, "hourly_raw", measures, **info)
    # Read back, so that neither frame recomputes the input.
    stored = raw if not replace else get_hourly_raw(spark, root)
    # One pass builds features and labels; both tables are cut from its result.
    staged = f"{root}/staging/{uuid.uuid4().hex}"
    frame = hourly_training_frame(stored, drop_unlabelled=False)
    frame.write.option("compression", COMPRESSION).parquet(staged)
    built = spark.read.parquet(staged)
    write_feature_table(
        built.drop(*TARGET_COLUMNS), root, "hourly_observations", features, **info
    )
    full = built.dropna(subset=list(TARGET_COLUMNS))
    missing = [c for c in features if c not in full.columns]
    if missing:
        raise ValueError(f"labelled frame lacks observation columns {missing}")
    write_feature_table(full, root, "hourly_features", features, TARGET_COLUMNS, **info)
    return table_stats(spark, root)


def backfill_daily(
    spark, daily: DataFrame, root: str, replace: bool = True, source: str = "", **meta
) -> DataFrame:
    """Store the daily training frame."""
    frame = daily_training_frame(daily)
    features = daily_feature_columns(present(daily, BASE_COLUMNS))
    write_feature_table(
        frame,
        root,
        "daily_features",
        features,
        [f"target_{h}d" for h in DAILY_HORIZONS],
        replace=replace,
        source=source,
        source_sha256=fingerprint(daily.select(*KEYS, DATE, DAILY_AQI)),
        **meta,
    )
    return table_stats(spark, root)


def export_table(df: DataFrame, path: str, start=None, end=None) -> None:
    """CSV with a header, optionally of a time slice."""
    time_slice(df, start, end).write.mode("overwrite").option("header", True).csv(path)
