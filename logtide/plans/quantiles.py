"""Exact quantiles without gathering a group.

The built-in exact ``percentile`` keeps every distinct value of a group in one aggregation buffer. Here a
fixed-size sketch only proposes two values around the wanted rank; one pass then counts, map-side combined, the
rows below, at, between and above them, which tells exactly where the rank lies: at one of the two, or in an open
interval between actual values. An interval with few rows is sorted, a larger one gets a sketch of its own. The
ends of an interval never belong to it, so every pass shrinks it whatever the values are, and a poor proposal
costs a pass but never a wrong result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.plans.bounded import join_small, settle

#: Size of the proposing sketch; the first interval holds about 4 / ACCURACY of the rows.
ACCURACY = 10_000
#: Cells of the sketch inside an interval.
CELLS = 100
#: Rows of an interval that are sorted directly.
DIRECT_ROWS = 200_000

_ID = ["_g", "_i", "_k"]


def exact_quantile(df: DataFrame, value: str, probability: float, by: list[str] | None = None,
                   name: str = "quantile", discrete: bool = False, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Exact quantile of ``value`` per group: columns ``by`` + ``name``; see ``exact_quantiles``."""
    return exact_quantiles(df, value, {name: probability}, by, discrete, direct_rows)


def exact_quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: list[str] | None = None,
                    discrete: bool = False, direct_rows: int = DIRECT_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quantiles of ``value`` per group, all probabilities in the same passes: ``by`` and a column for each.

    Nulls are left out; infinities are values, NaN is above them all. The default interpolates linearly between
    neighbours; ``discrete`` gives the smallest value whose cumulative share reaches the probability. ``df`` is
    read three times or more, so hand in a stored table when the value is costly to compute. ``direct_rows`` and
    ``accuracy`` are plan settings and change no result.
    """
    by = by or []
    keys = [f"_key{i}" for i in range(len(by))]
    group = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in by], F.lit(""))
    rows = df.select(
        group.alias("_g"), *[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_x")
    ).filter(F.col("_x").isNotNull()).withColumn("_v", F.when(F.isnan("_x"), float("inf")).otherwise(F.col("_x")))
    margin = 2.0 / accuracy
    around = [q for p in wanted.values() for q in (max(0.0, p - margin), min(1.0, p + margin))]
    groups = settle(rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.isnan("_x")).alias("_nan"),
        F.percentile_approx("_v", F.array(*map(F.lit, around)), accuracy).alias("_cuts"),
        *[F.first(k).alias(k) for k in keys]))
    rows = rows.select("_g", "_v")

    if discrete:
        ranks = [F.greatest(F.ceil(F.round(F.lit(p) * F.col("_n"), 9)) - 1, F.lit(0)).cast("double")
                 for p in wanted.values()]
    else:
        ranks = [F.lit(p) * (F.col("_n") - 1) for p in wanted.values()]
    nothing, few = F.lit(None).cast("double"), F.col("_n") <= direct_rows
    asked = [F.struct(F.lit(i).alias("_i"), k.cast("long").alias("_k"), F.get("_cuts", F.lit(2 * i)).alias("_lo"),
                      F.get("_cuts", F.lit(2 * i + 1)).alias("_hi"))
             for i, r in enumerate(ranks) for k in (F.floor(r), F.ceil(r))]
    state = groups.select("_g", "_n", F.inline(F.array_distinct(F.array(*asked)))).select(
        *_ID, nothing.alias("_a"), nothing.alias("_b"), F.lit(0).cast("long").alias("_base"), "_lo", "_hi", "_n")
    hits = _pick(rows, state.filter(few))
    many = state.filter(~few)
    while not many.isEmpty():
        state = settle(_count(rows, many))
        hits = hits.unionByName(state.filter(F.col("_hit").isNotNull()).select(*_ID, "_hit"))
        open_ = state.filter(F.col("_hit").isNull())
        hits = hits.unionByName(_pick(rows, open_.filter(F.col("_size") <= direct_rows)))
        many = open_.filter(F.col("_size") > direct_rows)
        many = many if many.isEmpty() else _propose(rows, many)
    ends = hits.groupBy("_g").agg(*[
        f(F.when(F.col("_i") == i, F.struct("_k", "_hit"))).alias(f"{end}{i}")
        for i in range(len(wanted)) for f, end in ((F.min, "_low"), (F.max, "_high"))])
    done = join_small(ends, groups, "_g", "inner")
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys)],
                       *[_between(i, r).alias(name) for i, (r, name) in enumerate(zip(ranks, wanted))])


def _between(i: int, rank: Column) -> Column:
    def end(of: Column) -> Column:  # the last places of a group are its NaN values
        nan = (of["_hit"] == float("inf")) & (of["_k"] >= F.col("_n") - F.col("_nan"))
        return F.when(nan, float("nan")).otherwise(of["_hit"])

    low, high = end(F.col(f"_low{i}")), end(F.col(f"_high{i}"))
    share = rank - F.floor(rank)
    return F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share)


def _inside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of each open interval (``_a``, ``_b``); null is no bound."""
    inner = (F.col("_a").isNull() | (F.col("_v") > F.col("_a"))) & (F.col("_b").isNull() | (F.col("_v") < F.col("_b")))
    return join_small(rows, state, "_g", "inner").filter(inner)


def _count(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``_hit`` where the rank lies at a proposed value, else the smaller interval it lies in."""
    v, lo, hi, k, base = (F.col(c) for c in ("_v", "_lo", "_hi", "_k", "_base"))
    counted = _inside(rows, state).groupBy(*_ID, "_a", "_b", "_base", "_lo", "_hi").agg(
        F.count_if(v < lo).alias("_c0"), F.count_if(v == lo).alias("_c1"), F.count_if((v > lo) & (v < hi)).alias("_c2"),
        F.count_if((v == hi) & (hi > lo)).alias("_c3"), F.count_if(v > hi).alias("_c4"))
    counted = counted.withColumn("_s1", base + F.col("_c0")).withColumn("_s2", F.col("_s1") + F.col("_c1"))
    counted = counted.withColumn("_s3", F.col("_s2") + F.col("_c2")).withColumn("_s4", F.col("_s3") + F.col("_c3"))
    left, lower, inner, upper = k < F.col("_s1"), k < F.col("_s2"), k < F.col("_s3"), k < F.col("_s4")

    def pick(left_of, inside, right_of):
        return F.when(left, left_of).when(inner, inside).otherwise(right_of)

    hit = F.when(left, None).when(lower, lo).when(inner, None).when(upper, hi)
    return counted.select(
        *_ID, hit.cast("double").alias("_hit"), pick(F.col("_a"), lo, hi).alias("_a"), pick(lo, hi, F.col("_b")).alias("_b"),
        pick(base, F.col("_s2"), F.col("_s4")).alias("_base"),
        pick(F.col("_c0"), F.col("_c2"), F.col("_c4")).alias("_size"))


def _propose(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Two values around the rank, from a sketch of the interval's own rows."""
    grid = F.array(*[F.lit(j / CELLS) for j in range(CELLS + 1)])
    cuts = _inside(rows, state).groupBy(*_ID, "_a", "_b", "_base", "_size").agg(
        F.percentile_approx("_v", grid, 10 * CELLS).alias("_cuts"))
    cell = (F.col("_k") - F.col("_base")) / F.col("_size") * CELLS
    return cuts.select(
        *_ID, "_a", "_b", "_base", F.get("_cuts", F.greatest(F.lit(0), F.floor(cell) - 1).cast("int")).alias("_lo"),
        F.get("_cuts", F.least(F.lit(CELLS), F.ceil(cell) + 1).cast("int")).alias("_hi"))


def _pick(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The value at the rank of each interval, which holds few rows."""
    upto = Window.partitionBy(*_ID).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        _inside(rows, state.select(*_ID, "_a", "_b", "_base"))
        .groupBy(*_ID, "_base", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.col("_base") + F.sum("_c").over(upto))
        .filter((F.col("_end") - F.col("_c") <= F.col("_k")) & (F.col("_k") < F.col("_end")))
        .select(*_ID, F.col("_v").alias("_hit"))
    )


def column_quantiles(df: DataFrame, columns: list[str], probability: float) -> DataFrame:
    """column_name, value: the smallest value of each column whose cumulative share reaches the probability.

    As ``exact_quantile`` with ``discrete``, without making a row of every cell: one row of sketches proposes an
    interval for each column, one row of counts tells where the rank lies, and only the cells inside the intervals
    become rows. Columns whose rank lies outside the proposal are searched for by ``exact_quantiles``.
    """
    def plain(c):
        x = F.col(c).cast("double")
        return F.when(F.isnan(x), float("inf")).otherwise(x)

    margin = 2.0 / ACCURACY
    around = F.array(F.lit(max(0.0, probability - margin)), F.lit(min(1.0, probability + margin)))
    first = df.agg(*[x for i, c in enumerate(columns) for x in (
        F.count(c).alias(f"n{i}"), F.count_if(F.isnan(F.col(c).cast("double"))).alias(f"nan{i}"),
        F.percentile_approx(plain(c), around, ACCURACY).alias(f"cuts{i}"))]).first()
    known = [i for i in range(len(columns)) if first[f"n{i}"]]
    low = {i: float(first[f"cuts{i}"][0]) for i in known}
    high = {i: float(first[f"cuts{i}"][1]) for i in known}
    rank = {i: max(0, math.ceil(round(probability * first[f"n{i}"], 9)) - 1) for i in known}
    found: dict[int, float | None] = dict.fromkeys(range(len(columns)))
    left, inside = [], []
    if known:
        second = df.agg(*[x for i in known for x in (
            F.count_if(plain(columns[i]) < low[i]).alias(f"below{i}"), F.count_if(plain(columns[i]) <= high[i]).alias(f"upto{i}"),
            F.count_if(plain(columns[i]) == low[i]).alias(f"at{i}"), F.count_if(plain(columns[i]) < high[i]).alias(f"under{i}"))]).first()
        for i in known:
            below, k = second[f"below{i}"], rank[i]
            if not below <= k < second[f"upto{i}"]:
                left.append(i)
            elif k < below + second[f"at{i}"]:
                found[i] = low[i]
            elif k >= second[f"under{i}"]:
                found[i] = high[i]
            else:
                inside.append(i)
                rank[i] -= below + second[f"at{i}"]
    if inside:
        pairs = [F.struct(F.lit(i).alias("i"), F.when((plain(columns[i]) > low[i]) & (plain(columns[i]) < high[i]),
                                                      plain(columns[i])).alias("v")) for i in inside]
        cells = df.select(F.explode(F.filter(F.array(*pairs), lambda c: c["v"].isNotNull())).alias("c")).select("c.*")
        counted = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        place = F.element_at(F.create_map(*[F.lit(x) for i in inside for x in (i, rank[i])]), F.col("i"))
        end = F.sum("c").over(upto)
        for r in counted.withColumn("end", end).filter((F.col("end") - F.col("c") <= place) & (place < F.col("end"))).collect():
            found[r["i"]] = r["v"]
    for i in left:
        found[i] = exact_quantile(df, columns[i], probability, name="q", discrete=True).first()["q"]
    for i in known:  # the last places of a column are its NaN values
        if found[i] == float("inf") and rank[i] >= first[f"n{i}"] - first[f"nan{i}"]:
            found[i] = float("nan")
    return df.sparkSession.createDataFrame([(c, found[i]) for i, c in enumerate(columns)], "column_name string, value double")
