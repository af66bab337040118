"""Trailing time frames (``RANGE BETWEEN t PRECEDING AND CURRENT ROW`` over epoch seconds).

All rows of one second are peers and share one frame, so a frame is evaluated per (key, second) instead
of per row. Rows are first combined to one moment row per second - map-side, so neither a hot key nor a
hot second gathers anywhere. The size of that table depends on the time span, not on the number of rows.

Spark evaluates a sliding frame anew for every row, which costs rows x frame length: hours of work for an
hour-long frame over dense seconds. The frames therefore slide in numpy, each put together from a few runs
of doubling length. Only the per-second table crosses to Python, in day-long groups that hold at most one
row per second.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.plans.ordering import RowOrder, with_cell

_DAY = 86_400


def per_second(df: DataFrame, order: RowOrder, *extra: Column, value: Column | None = None) -> DataFrame:
    """One row per (``_key``, ``_sec``): ``_rows``, moments of ``value`` (``_n``, ``_mean``, ``_m2``,
    ``_sum``, ``_min``, ``_max``) and any ``extra`` aggregates."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    if value is not None:
        v = F.col("_value")
        aggs += [
            F.count(v).alias("_n"), F.sum(v).alias("_sum"), F.avg(v).alias("_mean"),
            (F.var_pop(v) * F.count(v)).alias("_m2"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        ]
        df = df.withColumn("_value", value.cast("double"))
    return with_cell(df, order).groupBy("_key", "_sec").agg(*aggs, *extra)


_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _ARROW[f.dataType]) for f in schema.fields])


@dataclass(frozen=True)
class Trailing:
    """One trailing aggregate over ``seconds``: ``sum``, ``min`` or ``max`` of a per-second column, or
    ``mean`` or sample ``variance`` of the value of ``per_second``."""

    stat: str
    seconds: int
    column: str | None = None

    def inputs(self) -> tuple[str, ...]:
        return (self.column,) if self.column else ("_n", "_mean", "_m2")


def over_trailing(cells: DataFrame, frames: dict[str, Trailing], keep: list[str] | None = None) -> DataFrame:
    """Per-second table with the trailing aggregates; of its other columns the key, ``_rows`` and ``keep``.

    Time is cut into slices of a day, each with copies of the seconds just before it, so that one key
    spreads over many tasks.
    """
    longest = max(f.seconds for f in frames.values())
    width = max(_DAY, 4 * (longest + 1))
    kept = ["_key", "_sec", "_rows", *(keep or [])]
    inputs = sorted({c for f in frames.values() for c in f.inputs()})
    types = {f.name: f.dataType for f in cells.schema.fields}
    whole = {name for name, f in frames.items() if types.get(f.column) == T.LongType()}

    home = F.floor(F.col("_sec") / width)
    late = F.col("_sec") - home * width >= width - longest
    sliced = cells.select(
        *dict.fromkeys([*kept, *inputs]),
        F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))).alias("_slice"),
        home.alias("_home"),
    )
    schema = T.StructType([cells.schema[c] for c in kept] + [
        T.StructField(name, T.LongType() if name in whole else T.DoubleType()) for name in frames])
    arrow = to_arrow_schema(schema)

    def slide(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group["_sec"].to_numpy()))
        second = group["_sec"].to_numpy()
        columns = {c: group[c].to_numpy().astype("float64") for c in inputs}  # nulls become NaN
        own = group["_slice"].to_numpy() == group["_home"].to_numpy()
        out = [group[c].filter(own) for c in kept]
        done: dict = {}
        for frame in frames.values():
            key = (frame.inputs(), frame.seconds, "" if frame.column is None else frame.stat)
            if key not in done:
                start = np.searchsorted(second, second - frame.seconds)
                merge = _merge_moments if frame.column is None else _MERGES[frame.stat]
                done[key] = _slide([columns[c] for c in frame.inputs()], start, merge)
        for name, frame in frames.items():
            parts = done[frame.inputs(), frame.seconds, "" if frame.column is None else frame.stat]
            if frame.stat == "mean":
                result = np.where(parts[0] > 0, parts[1], np.nan)
            elif frame.stat == "variance":
                result = np.where(parts[0] > 1, parts[2] / np.maximum(parts[0] - 1, 1), np.nan)
            else:
                result = parts[0]
            if name in whole:
                out.append(pa.array(np.nan_to_num(result[own]).round().astype("int64")))
            else:
                out.append(pa.array(result[own], from_pandas=True))
        return pa.Table.from_arrays(out, schema=arrow)

    return sliced.groupBy("_key", "_slice").applyInArrow(slide, schema)


def _merge_sums(a, b):
    return [np.where(np.isnan(a[0]), b[0], np.where(np.isnan(b[0]), a[0], a[0] + b[0]))]


def _merge_moments(a, b):
    """Count, mean and sum of squared deviations of two disjoint sets together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    share = b[0] / np.maximum(n, 1)
    both = (a[0] > 0) & (b[0] > 0)
    mean = np.where(both, a[1] + gap * share, np.where(a[0] > 0, a[1], b[1]))
    m2 = np.where(both, a[2] + b[2] + gap * gap * a[0] * share, np.where(a[0] > 0, a[2], b[2]))
    return [n, mean, m2]


_MERGES = {
    "sum": _merge_sums,
    "min": lambda a, b: [np.fmin(a[0], b[0])],
    "max": lambda a, b: [np.fmax(a[0], b[0])],
}


def _slide(columns: list[np.ndarray], start: np.ndarray, merge) -> list[np.ndarray]:
    """Aggregate of the entries ``start[i]`` … ``i`` for each i.

    Every frame is put together from disjoint runs of 1, 2, 4, … entries, so nothing is ever subtracted
    and small values keep their digits beside large ones.
    """
    index = np.arange(len(start))
    length = index - start + 1
    nothing = [np.zeros(len(start)) if len(columns) > 1 and i == 0 else np.full(len(start), np.nan)
               for i in range(len(columns))]
    result, at, runs, size = nothing, index.copy(), columns, 1
    while True:
        hit = (length & size) > 0
        joined = merge([c[hit] for c in result], [r[at[hit]] for r in runs])
        for c, j in zip(result, joined):
            c[hit] = j
        at[hit] -= size
        if size * 2 > length.max():
            return result
        shifted = [np.concatenate([np.full(size, 0.0 if len(columns) > 1 and i == 0 else np.nan), r[:-size]])
                   for i, r in enumerate(runs)]
        runs, size = merge(runs, shifted), size * 2
