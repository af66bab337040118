"""Joins with tables that are usually, but not provably, small."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.plans.materialize import materialize

#: Most rows a table may have to be broadcast, and most bytes of one row's strings, arrays and the like: 32 MB in all.
BROADCAST_ROWS, ROW_BYTES = 50_000, 640


def fetch_bounded(df: DataFrame, limit: int = BROADCAST_ROWS, row_bytes: int = ROW_BYTES):
    """Rows of ``df`` as a local Arrow table, or None when there are more than ``limit`` or one is too wide.

    Values of wide rows are left out before they are fetched, so what travels is bounded whatever they hold.
    """
    open_ = {c: t for c, t in df.dtypes if t.startswith(("string", "binary", "array", "map", "struct", "variant"))}
    head = df.limit(limit + 1)
    if open_:
        sizes = [F.octet_length(c) if t in ("string", "binary") else F.octet_length(F.to_json(F.struct(c)))
                 for c, t in open_.items()]
        fits = sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(0)) <= row_bytes
        head = head.withColumns({c: F.when(fits, F.col(c)) for c in open_} | {"_fits": fits})
    head = head.toArrow()
    if head.num_rows > limit or (open_ and not pc.all(head["_fits"], min_count=0).as_py()):
        return None
    return head.drop(["_fits"]) if open_ else head


def settle(df: DataFrame) -> DataFrame:
    """``df`` evaluated once: as a local table when it is small, else stored."""
    head = fetch_bounded(df)
    return materialize(df) if head is None else df.sparkSession.createDataFrame(head, schema=df.schema)


def join_small(rows: DataFrame, small: DataFrame, on: str | list[str], how: str = "left",
               limit: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """Join ``rows`` with a table keyed by ``on``. With ``null_safe`` a null key is a key like any other.

    ``small`` is measured first, up to ``limit + 1`` rows. Within the limits it is broadcast, so that
    a key holding a third of ``rows`` needs no shuffle at all; beyond it the join is a shuffle
    join, whose hot partitions AQE splits on the ``rows`` side.
    """
    head = fetch_bounded(small, limit)
    if head is not None:
        small = F.broadcast(rows.sparkSession.createDataFrame(head, schema=small.schema))
    if not null_safe:
        return rows.join(small, on, how)
    keys = [on] if isinstance(on, str) else on
    named = small.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = [rows[k].eqNullSafe(named[f"_of_{k}"]) for k in keys]
    return rows.join(named, match, how).drop(*[f"_of_{k}" for k in keys])
