"""The feature table of a stream of log rows, from keyed state.

The state of a log type holds the rows whose second may still grow, the moments of each second of the trailing hour,
and the last rows' lagged values; a row is given out once the watermark has passed its second. What a row gets does not
depend on how the stream is cut into batches, and no stored row is read again. State per type is bounded by the hour,
the lateness and what arrives in them; a batch's rows of one type are one group, as lags need their order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logtide.functions import logs as fn
from logtide.operators.features import LAGGED, temporal_features, _add_statistical, select_existing
from logtide.schemas import FEATURE_TABLE, FEATURE_TABLE_EXTRA

#: Seconds of the trailing frames, by output column.
COUNTS = {"count_5min": 300, "count_15min": 900, "count_1hour": 3600}
VALUES = 300
STEPS = 3


class TypeState:
    """Rows waiting for their second to be over, moments per second, and the last rows' values."""

    def __init__(self):
        self.waiting: pd.DataFrame | None = None
        self.seconds = np.empty(0, np.int64)
        self.moments = np.empty((0, 4))  # ids, values, sum of the values, largest value (-inf without any)
        self.last = {c: [] for c in LAGGED.values()}

    def add(self, rows: pd.DataFrame) -> None:
        self.waiting = rows if self.waiting is None else pd.concat([self.waiting, rows], ignore_index=True)

    def take(self, before: int) -> pd.DataFrame | None:
        """The waiting rows of seconds before ``before``, in order, with their trailing and lagged values."""
        if self.waiting is None:
            return None
        over = self.waiting["_sec"] < before
        ready = self.waiting[over]
        self.waiting = self.waiting[~over] if not over.all() else None
        if ready.empty:
            return None
        ready = ready.sort_values(["timestamp", "log_id"], kind="stable", na_position="first").reset_index(drop=True)
        self._count(ready)
        return ready.assign(**self._trailing(ready["_sec"].to_numpy())).pipe(self._lagged)

    def _count(self, rows: pd.DataFrame) -> None:
        value = rows["_value"].to_numpy(float)
        known = ~np.isnan(value)
        seconds, at = np.unique(rows["_sec"].to_numpy(), return_inverse=True)
        new = np.zeros((len(seconds), 4))
        new[:, 3] = -np.inf
        np.add.at(new[:, 0], at, rows["log_id"].notna().to_numpy(float))
        np.add.at(new[:, 1], at, known.astype(float))
        np.add.at(new[:, 2], at, np.where(known, value, 0))
        np.maximum.at(new[:, 3], at[known], value[known])
        self.seconds = np.concatenate([self.seconds, seconds])
        self.moments = np.concatenate([self.moments, new])

    def _trailing(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        seconds, at = np.unique(rows, return_inverse=True)
        last = np.searchsorted(self.seconds, seconds, "right")
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(self.moments[:, :2], axis=0)])
        out = {}
        for name, width in COUNTS.items():
            first = np.searchsorted(self.seconds, seconds - width, "left")
            out[name] = (sums[last, 0] - sums[first, 0]).astype(np.int64)[at]
        first = np.searchsorted(self.seconds, seconds - VALUES, "left")
        n = sums[last, 1] - sums[first, 1]
        # sums within the frame, not differences of running sums, which lose digits as the stream goes on
        total = np.array([self.moments[a:b, 2].sum() for a, b in zip(first, last)])
        top = np.array([self.moments[a:b, 3].max() for a, b in zip(first, last)])
        out["avg_response_time_5min"] = np.where(n > 0, total / np.maximum(n, 1), 0.0)[at]
        out["max_response_time_5min"] = np.where(n > 0, top, 0.0)[at]
        kept = self.seconds >= self.seconds[-1] - max(COUNTS.values())
        self.seconds, self.moments = self.seconds[kept], self.moments[kept]
        return out

    def _lagged(self, rows: pd.DataFrame) -> pd.DataFrame:
        columns = {}
        for prefix, source in LAGGED.items():
            line = np.array([*self.last[source], *rows[source].to_numpy(float)], float)
            ahead = len(self.last[source])
            for i in range(1, STEPS + 1):
                shifted = np.full(len(rows), np.nan)
                start = max(0, i - ahead)
                shifted[start:] = line[ahead + start - i:len(line) - i]
                columns[f"{prefix}_{i}"] = np.nan_to_num(shifted, nan=0.0)
            self.last[source] = line[-STEPS:].tolist()
        return rows.assign(**columns)


def stream_features(logs: DataFrame, statistics: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming feature table of streaming ``logs``, in append mode: the rows and columns of ``build_features``.

    ``statistics`` are a static frame of ``type_statistics``, in general of the rows that a model was trained on. Rows
    later than ``late`` behind the newest are dropped. A row comes out when the watermark has passed its second.
    """
    rows = logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    rows = temporal_features(rows).withColumn("log_level_encoded", fn.level_code(F.col("log_level")))
    rows = _add_statistical(rows.join(F.broadcast(statistics), "log_type", "left"))
    rows = select_existing(rows, FEATURE_TABLE + FEATURE_TABLE_EXTRA)[0].withColumns({
        "_sec": F.col("timestamp").cast("long"),
        "_value": fn.api_response_time(F.col("log_type"), F.col("response_time_ms")).cast("double")})
    own = [f for f in rows.schema.fields if f.name not in ("_sec", "_value")]
    given = [T.StructField(c, T.LongType()) for c in COUNTS] + [
        T.StructField(c, T.DoubleType()) for c in ("avg_response_time_5min", "max_response_time_5min")] + [
        T.StructField(f"{prefix}_{i}", T.LongType() if source in COUNTS else T.DoubleType())
        for prefix, source in LAGGED.items() for i in range(1, STEPS + 1)]
    names = [f.name for f in [*own, *given]]
    whole = [f.name for f in [*own, *given] if isinstance(f.dataType, (T.LongType, T.IntegerType))]
    nullable = {f.name: "Int64" if isinstance(f.dataType, T.LongType) else "Int32" for f in own
                if isinstance(f.dataType, (T.LongType, T.IntegerType))}

    def update(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = TypeState()
        if state.exists:
            vars(held).update(pickle.loads(state.get[0]))
        if not state.hasTimedOut:
            for part in parts:
                held.add(part.astype({c: k for c, k in nullable.items() if c in part.columns}))
        watermark = state.getCurrentWatermarkMs()
        ready = held.take(watermark // 1000)
        state.update((pickle.dumps(vars(held)),))
        if held.waiting is not None:
            state.setTimeoutTimestamp(max(watermark + 1, (int(held.waiting["_sec"].min()) + 1) * 1000))
        if ready is not None:
            yield ready[names].astype({c: "Int64" for c in whole if c in COUNTS or "_lag_" in c})

    found = rows.groupBy("log_type").applyInPandasWithState(
        update, T.StructType([*own, *given]), "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    found = found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).fillna(0)
    return select_existing(found, FEATURE_TABLE + FEATURE_TABLE_EXTRA)[0]
