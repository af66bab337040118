"""Row order inside skewed keys.

A log table has a handful of log types, so ``Window.partitionBy("log_type")`` would run in a handful
of tasks whatever the cluster size. The functions here give the same results with groups of bounded
size:

* rows are counted per *cell* (key, second) - a small table thanks to map-side combine;
* running totals over the cells give every cell its start position, so that ``row_number`` inside a
  cell yields the position of each row in its whole key;
* positions are cut into slices of equal row count, each with copies of the few rows before it, and
  ordinary row-based windows run per slice.

A second with more than ``hot_cell`` rows is cut further: by exact timestamp, and inside one timestamp
at split points of the tie-breaker, taken from a sample. A row's part is the number of split points not
above its tie-breaker, so ordering by (part, tie-breaker) is ordering by the tie-breaker wherever the split
points lie: the order is (key, time, tie-breaker) at every size, and ``hot_cell`` is a setting of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize

#: Rows in one (key, second) above which the second is split.
HOT_CELL_ROWS = 1_000_000
#: Rows per slice of an ordered key.
SLICE_ROWS = 100_000

_DAY = 86_400
#: Stand-in second of rows without a timestamp: they sort first, as nulls do in a window.
NO_TIME = -(2 ** 40)
#: Stand-in for a null key.
NO_KEY = "\u0000"


@dataclass(frozen=True)
class RowOrder:
    """Order of a log table: ``key`` (None for one global series), then ``time``, then ``tie``."""

    key: str | None = "log_type"
    time: str = "timestamp"
    tie: str = "log_id"

    def key_column(self) -> Column:
        if self.key is None:
            return F.lit(NO_KEY)
        return F.coalesce(F.col(self.key).cast("string"), F.lit(NO_KEY))

    def second_column(self) -> Column:
        return F.coalesce(F.unix_timestamp(F.col(self.time)), F.lit(NO_TIME).cast("long"))

    def micros_column(self) -> Column:
        return F.coalesce(F.unix_micros(F.col(self.time).cast("timestamp")), F.lit(NO_TIME).cast("long"))


def with_cell(df: DataFrame, order: RowOrder) -> DataFrame:
    """Add the cell columns ``_key`` and ``_sec``; neither is ever null."""
    return df.withColumns({"_key": order.key_column(), "_sec": order.second_column()})


def _second_starts(seconds: DataFrame) -> DataFrame:
    """Exclusive running total ``_start`` of ``_rows`` over the seconds of each ``_key``.

    Two levels - days, then the seconds of a day - keep every window group small.
    """
    counts = seconds.withColumn("_day", F.floor(F.col("_sec") / _DAY))
    before = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        counts.groupBy("_key", "_day").agg(F.sum("_rows").alias("_rows"))
        .select("_key", "_day", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_day_start"))
    )
    inside = Window.partitionBy("_key", "_day").orderBy("_sec").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.join(days, ["_key", "_day"])
        .withColumn("_start", F.col("_day_start") + F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .drop("_day", "_day_start")
    )


#: Sampled rows per part of a hot timestamp.
_SAMPLE = 20


def _tie_splits(rows: DataFrame, dense: DataFrame, order: RowOrder, limit: int) -> DataFrame:
    """``_splits`` of each hot timestamp: values of the tie-breaker that cut it into parts of about ``limit``
    rows, from about ``_SAMPLE`` rows per part."""
    instant = ["_key", "_sec", "_micros"]
    unit = F.shiftrightunsigned(F.xxhash64(order.tie), 11) / float(2 ** 53)
    drawn = join_small(rows.select(*instant, order.tie), dense.select(*instant, "_rows"), instant, "inner").filter(
        unit < _SAMPLE / F.lit(float(limit))).filter(F.col(order.tie).isNotNull())
    place = Window.partitionBy(*instant).orderBy(order.tie)
    every = drawn.withColumn("_at", F.row_number().over(place)).filter(F.col("_at") % _SAMPLE == 0)
    return every.groupBy(*instant).agg(F.array_sort(F.collect_set(order.tie)).alias("_splits"))


def _splits_not_above(splits: Column, value: Column) -> Column:
    """Number of elements of a sorted array that are not above ``value``, by halving; 0 for a null value."""
    def halve(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(splits, mid) <= value, F.lit(False))
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(splits) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi")), halve, lambda s: s["lo"])


def _split_hot_seconds(rows: DataFrame, cells: DataFrame, order: RowOrder, limit: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut seconds of more than ``limit`` rows by exact timestamp, and timestamps of more than ``limit``
    rows at split points. Returns the rows, the start of each part inside its second, and the cell columns.

    A second has at most a million timestamps, and a hot timestamp gets parts in proportion to its rows,
    so the parts of one second stay few however many rows it holds.
    """
    second, instant = ["_key", "_sec"], ["_key", "_sec", "_micros"]
    hot = cells.filter(F.col("_rows") > limit).select(*second, F.lit(True).alias("_hot"))
    rows = join_small(rows, hot, second).withColumn(
        "_micros", F.when(F.col("_hot"), order.micros_column()).otherwise(0)).drop("_hot")
    instants = materialize(rows.groupBy(*instant).agg(F.count(F.lit(1)).alias("_rows")))
    dense = instants.filter(F.col("_rows") > limit)
    if dense.isEmpty():
        rows = rows.withColumn("_part", F.lit(0).cast("long"))
    else:
        splits = materialize(_tie_splits(rows, dense, order, limit))
        rows = join_small(rows, splits, instant).withColumn(
            "_part", F.coalesce(_splits_not_above(F.col("_splits"), F.col(order.tie)), F.lit(0)).cast("long"))
        rows = rows.drop("_splits")
    cell = [*instant, "_part"]
    inside = Window.partitionBy(*second).orderBy("_micros", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")).select(
        *cell, F.coalesce(F.sum("_rows").over(inside), F.lit(0)).alias("_part_start"))
    return rows, starts, cell


def with_position(df: DataFrame, order: RowOrder = RowOrder(), cells: DataFrame | None = None,
                  hot_cell: int = HOT_CELL_ROWS) -> DataFrame:
    """Add ``_key``, ``_sec`` and ``_pos``, the dense 0-based position of each row inside its key.

    ``cells`` may hold one row per (``_key``, ``_sec``) with the count ``_rows`` and further columns;
    those further columns are attached to every row by the same join. The rows are shuffled once. ``df``
    is read more than once and must give the same keys and times each time.
    """
    rows = with_cell(df, order)
    if cells is None:
        cells = materialize(rows.groupBy("_key", "_sec").agg(F.count(F.lit(1)).alias("_rows")))
    starts, cell = _second_starts(cells).drop("_rows"), ["_key", "_sec"]
    if not cells.filter(F.col("_rows") > hot_cell).isEmpty():
        rows, part_starts, cell = _split_hot_seconds(rows, cells, order, hot_cell)
        starts = part_starts.join(starts, ["_key", "_sec"]).withColumn(
            "_start", F.col("_start") + F.col("_part_start")).drop("_part_start")
    inside = Window.partitionBy(*cell).orderBy(order.time, order.tie)
    return (
        rows.join(starts, cell)
        .withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_start", "_micros", "_part")
    )


def with_slices(df: DataFrame, before: int = 0, after: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``_slice`` and ``_own`` to rows with a position; ``df`` gains copies of border rows.

    Slice s holds positions [s*B, (s+1)*B) as its own rows, plus copies (``_own`` false) of the
    ``before`` rows ahead of it and the ``after`` rows behind it. Frames that reach no farther than
    that are complete inside (``_key``, ``_slice``); filter on ``_own`` afterwards.
    """
    size = max(slice_rows, before, after, 1)
    home = F.floor(F.col("_pos") / size)
    offset = F.col("_pos") - home * size
    nothing = F.array().cast("array<bigint>")
    targets = F.array(home)
    if before:
        targets = F.concat(targets, F.when(offset >= size - before, F.array(home + 1)).otherwise(nothing))
    if after:
        targets = F.concat(targets, F.when((offset < after) & (home > 0), F.array(home - 1)).otherwise(nothing))
    return (
        df.withColumn("_slice", F.explode(targets))
        .withColumn("_own", F.col("_slice") == home)
    )


def slice_window():
    """Window over the rows of one slice in their order."""
    return Window.partitionBy("_key", "_slice").orderBy("_pos")
