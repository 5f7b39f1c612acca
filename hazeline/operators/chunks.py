"""Cutting long series into time chunks that overlap just enough for the windows.

A window over a whole series would put that series into one task. Every frame
used here has a bounded reach, so a series is cut into chunks of fixed length
and each chunk also receives the rows its frames can reach on either side (its
halo). Windows run per (series, chunk), results are exact for the chunk's own
rows, and the halo rows are dropped afterwards. All windows of a chain share
one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.common import double
from hazeline.schema import DATE, KEYS, TIME

CHUNK = "_chunk"
OWN = "_own"
_BEFORE = "_before"
OFFSET = "_at_"
_OK = "_ok"


@dataclass(frozen=True)
class Grid:
    """Cadence of a table and the number of steps in one chunk."""

    column: str
    step: str
    chunk_steps: int

    def steps(self, time: Column | None = None) -> Column:
        """Steps since the epoch, as a whole number."""
        time = F.col(self.column) if time is None else time
        if self.step == "day":
            return F.unix_date(time).cast("bigint")
        return F.floor(F.unix_timestamp(time) / F.lit(3600)).cast("bigint")

    def at(self, steps: Column) -> Column:
        """Time of a whole number of steps since the epoch."""
        if self.step == "day":
            return F.date_from_unix_date(steps.cast("int"))
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), steps.cast("int"))

    def chunk(self, shift: int = 0) -> Column:
        return F.floor((self.steps() + F.lit(shift)) / F.lit(self.chunk_steps)).cast("bigint")


# Whole days per hourly chunk, so that a calendar day never spans two chunks.
HOURLY_GRID = Grid(TIME, "hour", 180 * 24)
DAILY_GRID = Grid(DATE, "day", 2048)


def sums_name(column: str) -> str:
    return f"_sums_{column}"


def offset_name(column: str, offset: int) -> str:
    return f"{OFFSET}{'back' if offset < 0 else 'ahead'}_{abs(offset)}_{column}"


def without_offsets(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(OFFSET)])


def _edge(rows: int) -> str:
    if rows == 0:
        return "CURRENT ROW"
    return f"{abs(rows)} {'PRECEDING' if rows < 0 else 'FOLLOWING'}"


@dataclass(frozen=True)
class Chunked:
    """A DataFrame cut into chunks, with columns over its rows in time order."""

    df: DataFrame
    grid: Grid
    keys: tuple[str, ...]

    def over(self, start: int | None = None, end: int | None = None) -> str:
        """OVER clause of the chunk's rows in time order, with a row frame if given."""
        rows = ""
        if start is not None:
            rows = f" ROWS BETWEEN {_edge(start)} AND {_edge(end)}"
        series = ", ".join([*self.keys, CHUNK])
        return f"OVER (PARTITION BY {series} ORDER BY {self.grid.column}{rows})"

    def then(self, step: Callable[[Chunked], DataFrame]) -> Chunked:
        return replace(self, df=step(self))

    def lag(self, column: str, rows: int) -> Column:
        return F.expr(f"lag({column}, {rows}) {self.over()}")

    def lead(self, column: str, rows: int) -> Column:
        return F.expr(f"lead({column}, {rows}) {self.over()}")

    def full(self, function: str, column: str, start: int, end: int) -> str:
        """An aggregate over rows ``start..end`` around the row; null unless all have a value."""
        over = self.over(start, end)
        return (
            f"CASE WHEN count({column}) {over} = {end - start + 1} "
            f"THEN {function}({column}) {over} END"
        )

    def mean(self, column: str, start: int, end: int) -> Column:
        return F.expr(self.full("avg", column, start, end))

    def with_offsets(self, offsets: dict[str, Iterable[int]]) -> Chunked:
        """Add the values at these offsets from the row, negative ones before it, for :meth:`at`.

        Spark looks an offset up as often as expressions name it, and as a column it is named once.
        """
        added = {offset_name(c, k): F.expr(self.at(c, k)) for c, found in offsets.items() for k in found if k}
        return replace(self, df=self.df.withColumns(added))

    def at(self, column: str, offset: int) -> str:
        """The value at an offset: the column of :meth:`with_offsets`, or its lookup."""
        if offset == 0:
            return column
        if offset_name(column, offset) in self.df.columns:
            return offset_name(column, offset)
        return f"{'lag' if offset < 0 else 'lead'}({column}, {abs(offset)}) {self.over()}"

    def _trailing(self, column: str, rows: int) -> list[str]:
        """Values of the last ``rows`` rows, oldest first, each read by its offset."""
        return [self.at(column, -k) for k in range(rows - 1, -1, -1)]

    def lagged_mean(self, column: str, rows: int) -> Column:
        """Mean over the last ``rows`` rows; null unless all have a value.

        For short frames: rows are read once by their offsets, where a frame would be summed anew at every row.
        """
        return F.expr(f"({' + '.join(self._trailing(column, rows))}) / {double(rows)}")

    def lagged_std(self, column: str, rows: int) -> Column:
        """Sample deviation over the last ``rows`` rows; null unless all have a value."""
        values = self._trailing(column, rows)
        mean = f"(({' + '.join(values)}) / {double(rows)})"
        squares = " + ".join(f"({v} - {mean}) * ({v} - {mean})" for v in values)
        return F.expr(f"sqrt(({squares}) / {double(rows - 1)})")

    def with_sums(self, columns, scale: float, squares: bool = False) -> Chunked:
        """Add running sums of ``columns`` in whole multiples of ``1 / scale``.

        A frame's sum is then a difference of two rows, whatever its length, and
        whole numbers make the difference exact. A chunk bounds the totals; an
        overflow would fail the job.
        """
        over = f"OVER (PARTITION BY {', '.join([*self.keys, CHUNK])} ORDER BY {self.grid.column} "
        over += "ROWS UNBOUNDED PRECEDING)"
        added = {}
        for c in columns:
            units = f"bigint(rint({c} * {double(scale)}))"
            fields = f"'n', count({c}) {over}, 's', coalesce(sum({units}) {over}, 0L)"
            if squares:
                fields += f", 'q', coalesce(sum({units} * {units}) {over}, 0L)"
            added[sums_name(c)] = F.expr(f"named_struct({fields})")
        return replace(self, df=self.df.withColumns(added))

    def _between(self, column: str, field: str, start: int, end: int) -> str:
        """Total of rows ``start..end`` around the row, from two running sums."""

        def at(offset: int) -> str:
            name = sums_name(column)
            return f"{name}.{field}" if offset == 0 else f"({self.at(name, offset)}).{field}"

        # Before the first row of the chunk the running sum is zero.
        return f"({at(end)} - coalesce({at(start - 1)}, 0L))"

    def summed_mean(self, column: str, start: int, end: int, scale: float) -> str:
        """Mean over rows ``start..end`` from running sums; null unless all have a value."""
        rows = end - start + 1
        count, total = (self._between(column, f, start, end) for f in ("n", "s"))
        return f"CASE WHEN {count} = {rows} THEN {total} / {double(rows * scale)} END"

    def summed_std(self, column: str, rows: int, scale: float) -> str:
        """Sample deviation over the last ``rows`` rows from running sums and squares."""
        count, total, squares = (
            self._between(column, f, -(rows - 1), 0) for f in ("n", "s", "q")
        )
        spread = f"({rows} * {squares} - {total} * {total})"
        return (
            f"CASE WHEN {count} = {rows} "
            f"THEN sqrt({spread} / {double(rows * (rows - 1))}) / {double(scale)} END"
        )

    def checked(self, previous: str, value: str) -> Column:
        """``value``, failing on a duplicate or a skipped step between ``previous`` and the row."""
        now = self.grid.column
        step = "1" if self.grid.step == "day" else "INTERVAL 1 HOUR"
        return F.expr(
            f"CASE WHEN {previous} = {now} THEN raise_error('duplicate {now} in a series') "
            f"WHEN {previous} + {step} <> {now} "
            f"THEN raise_error('series lacks a complete {self.grid.step} cadence') "
            f"ELSE {value} END"
        )

    def guarded(self) -> Chunked:
        """Fails on a duplicate or a skipped step inside a chunk.

        The check decides which rows pass, so no choice of columns prunes it.
        """
        placed = self.df.withColumn(_BEFORE, self.lag(self.grid.column, 1))
        return replace(self, df=placed.withColumn(_OK, self.checked(_BEFORE, "true")).where(_OK).drop(_OK, _BEFORE))

    def own_rows(self) -> DataFrame:
        return self.df.where(OWN).drop(OWN)

    def result(self, keep_chunks: bool = False) -> DataFrame:
        """The chunks' own rows; with their chunk, so that :func:`with_positions` needs no exchange, if asked for."""
        return self.own_rows() if keep_chunks else self.own_rows().drop(CHUNK)


def require_joined(df: DataFrame, grid: Grid, keys) -> None:
    """Refuse a series that has fewer rows than steps between its first and its last.

    Windows see a gap or a duplicate inside their chunk, but not a gap longer than the halo that meets a chunk
    edge. Without duplicates, the number of rows shows any gap: one pass over the keys and the time, combined
    before the shuffle to a row per series, whatever the number of chunks.
    """
    steps = grid.steps()
    spans = df.groupBy(*keys).agg(F.min(steps).alias("_a"), F.max(steps).alias("_b"), F.count(steps).alias("_rows"))
    if not spans.where("_rows <= _b - _a").isEmpty():
        raise ValueError(f"series lacks a complete {grid.step} cadence")


def cut(
    df: DataFrame, grid: Grid, back: int = 0, ahead: int = 0, keys: tuple[str, ...] = KEYS
) -> Chunked:
    """Cut ``df`` into chunks with halos of ``back`` earlier and ``ahead`` later steps.

    A series with a gap is refused at once, as chunks can't tell one at their edge
    from the end of the series; :meth:`Chunked.guarded` fails the job for whatever
    is wrong inside a chunk. The windows need one exchange and no join.
    """
    require_joined(df, grid, keys)
    # A row serves every chunk whose halo reaches it: nearly always just its own.
    home = f"{OWN}_chunk"
    spread = df.withColumn(home, grid.chunk())
    if back == 0 and ahead == 0:
        spread = spread.withColumn(CHUNK, F.col(home))
    else:
        spread = spread.withColumn(
            CHUNK, F.explode(F.sequence(grid.chunk(-ahead), grid.chunk(back)))
        )
    return Chunked(spread.withColumn(OWN, F.col(CHUNK) == F.col(home)).drop(home), grid, tuple(keys))


def with_positions(
    df: DataFrame, grid: Grid, keys: tuple[str, ...] = KEYS, pos: str = "pos", n: str = "n"
) -> DataFrame:
    """Add the zero-based position of each row in its series and the series' row count.

    Rows are numbered inside chunks and shifted by the counts of earlier chunks,
    so only the small per-chunk counts are ever ordered per series. Rows that still have their chunk
    from :meth:`Chunked.result` are numbered where the windows left them.
    """
    keys = tuple(keys)
    marked = df if CHUNK in df.columns else df.withColumn(CHUNK, grid.chunk())
    series = Window.partitionBy(*keys)
    before = series.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(
        *keys,
        CHUNK,
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(series).alias(n),
    )
    inside = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(grid.column))
    return (
        marked.withColumn("_inside", inside)
        .join(offsets, [*keys, CHUNK])
        .withColumn(pos, F.col("_offset") + F.col("_inside") - 1)
        .drop(CHUNK, "_inside", "_offset")
    )
