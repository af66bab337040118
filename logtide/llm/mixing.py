"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents should be taken p = target / size times on average. The whole part of p is certain; the
fraction is rounded: two documents meet, words are moved from one's fraction to the other's - which way is
random, with the odds that leave every expectation unchanged - until one of the fractions is 0 or 1. That one
is decided, the other meets the next. The words taken by a source stay what they were at every step, and only
the last fraction of a source is rounded by a plain draw.

Documents are ordered by size, largest first, in groups of at most ``GROUP`` rows. Each of a source's largest
documents - its first group - meets all smaller ones as one partner, whose members share the words moved, so
that no large document is left over in the end. All others meet one another within their groups; the residuals
of the groups, one each, meet in the same way one level up, until one per source is left: a reduction tree, with
``GROUP`` times fewer rows at each level. A source that holds a third of all rows is just more groups. Draws are
hashes of the places of those that meet, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.rows import keep_rows, numbered, row_hash, stored_keys, words_of
from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Most copies of a document, and most of a source's size that its target may be.
MOST_COPIES = 3
#: Rows that meet in one group.
GROUP = 256


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: all sizes shared by weight, within ``most`` times the own.

    Weights go to the sources by code point, null last, and repeat. What lies above a limit is shared again by
    weight among the others until none is above; each round is one aggregate of two numbers.
    """
    keyed = sources.withColumn("_null", F.col("source").isNull())
    ranked, _, total = numbered(keyed, ["_null", "source"], "source_size")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranked.select(
        "source", "source_size", F.get(cycle, (F.col("_position") % len(weights)).cast("int")).alias("_weight"),
        (F.col("source_size") * float(most)).alias("_most")))
    rate = 0.0
    while True:
        open_ = F.col("_weight") * rate < F.col("_most")
        row = ranked.agg(F.sum(F.when(open_, F.col("_weight"))).alias("w"),
                         F.sum(F.when(~open_, F.col("_most"))).alias("full")).first()
        if not row["w"]:
            break
        after = (float(total or 0) - (row["full"] or 0.0)) / row["w"]
        if after <= rate:
            break
        rate = after
    return ranked.select("source", "source_size", F.least(F.col("_weight") * rate, "_most").alias("target"))


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(2 ** 53)


def _meet(seed: int, level: int):
    """Step of the fold: the open unit and the next one move words; one of them is decided."""
    def step(s, x):
        a, b, size_a, size_b = s["p"], x["p"], s["size"], x["size"]
        up = F.least((1 - a) * size_a, b * size_b)        # words that can go to the open unit
        down = F.least(a * size_a, (1 - b) * size_b)      # or to the next one
        to_a = _uniform(F.lit(seed), F.lit(level), s["at"], x["at"]) * (up + down) < down
        a2 = F.when(to_a, a + up / size_a).otherwise(a - down / size_a)
        b2 = F.when(to_a, b - up / size_b).otherwise(b + down / size_b)
        # the one whose limit stopped the move is decided
        a_done = F.when(to_a, (1 - a) * size_a <= b * size_b).otherwise(a * size_a <= (1 - b) * size_b)
        decided = F.struct(F.when(a_done, s["at"]).otherwise(x["at"]).alias("at"),
                           (a_done == to_a).cast("int").alias("take"))

        def within(p):
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))

        return F.struct(F.when(a_done, x["at"]).otherwise(s["at"]).alias("at"),
                        F.when(a_done, within(b2)).otherwise(within(a2)).alias("p"),
                        F.when(a_done, size_b).otherwise(size_a).alias("size"),
                        F.concat(s["done"], F.array(decided)).alias("done"))

    return step


def _meet_rest(seed: int):
    """Step of the fold over a source's largest documents: each meets the bundle of all smaller ones."""
    def step(s, x):
        p, size, rest = s["p"], x["size"], s["rest"] - x["size"]
        up = F.least((1 - p) * size, p * rest)
        down = F.least(p * size, (1 - p) * rest)
        draw = _uniform(F.lit(seed), F.lit(-2), x["at"])
        to_x = draw * (up + down) < down
        own = F.when(rest == 0, p).when(to_x, p + up / size).otherwise(p - down / size)
        settled = F.when(to_x, (1 - p) * size <= p * rest).otherwise(p * size <= (1 - p) * rest)
        last = _uniform(F.lit(seed), F.lit(-3), x["at"]) < own  # its partner became integral, or there is none
        take = F.when((rest > 0) & settled, to_x).otherwise(last).cast("int")
        after = F.when(rest == 0, p).when(to_x, p - up / rest).otherwise(p + down / rest)
        after = F.when((rest > 0) & ~settled, F.when(to_x, 0.0).otherwise(1.0)).otherwise(after)
        return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(1.0), after)).alias("p"), rest.alias("rest"),
                        F.concat(s["done"], F.array(F.struct(x["at"].alias("at"), take.alias("take")))).alias("done"))

    return step


def _round_largest(units: DataFrame, seed: int) -> DataFrame:
    """(source_no, p, done): fates of the first group of each source, and the fraction left to all others."""
    first = units.filter("group = 0").groupBy("source_no").agg(
        F.sort_array(F.collect_list(F.struct("at", "size"))).alias("u"), F.first("p").alias("p"),
        F.first("source_size").alias("rest"))
    start = F.struct("p", "rest", F.expr("cast(array() as array<struct<at: bigint, take: int>>)").alias("done"))
    folded = first.select("source_no", F.aggregate("u", start, _meet_rest(seed)).alias("s"))
    return folded.select("source_no", "s.p", "s.done")


def _round_fractions(units: DataFrame, seed: int) -> DataFrame:
    """(at, take) for units (source_no, group, at, p, size); ``group`` counts within a source."""
    decided, level = None, 0
    while True:
        unit = F.struct("at", "p", "size")
        members = units.groupBy("source_no", "group").agg(F.sort_array(F.collect_list(unit)).alias("u"))
        start = F.struct(F.get("u", F.lit(0))["at"].alias("at"), F.get("u", F.lit(0))["p"].alias("p"),
                         F.get("u", F.lit(0))["size"].alias("size"),
                         F.expr("cast(array() as array<struct<at: bigint, take: int>>)").alias("done"))
        rest = F.expr("slice(u, 2, size(u))")
        folded = materialize(members.select(
            "source_no", "group", F.aggregate(rest, start, _meet(seed, level)).alias("s")))
        done = folded.select(F.explode("s.done").alias("d")).select("d.at", "d.take")
        decided = done if decided is None else decided.unionByName(done)
        residual = folded.select("source_no", "group", "s.at", "s.p", "s.size")
        if folded.groupBy("source_no").count().filter("count > 1").isEmpty():
            draw = _uniform(F.lit(seed), F.lit(-1), F.col("at"))
            return decided.unionByName(residual.select("at", (draw < F.col("p")).cast("int").alias("take")))
        units = residual.withColumn("group", F.expr(f"group div {GROUP}"))
        level += 1


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 13) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target, copies, taken (and _hash).

    Size counts the words of the text; null has none. Documents without words are taken a whole number of times
    and count nothing. A null source is a source of its own, the last. A source without words has target 0 and
    gives no document. Repeated rows are documents of their own. An empty table gives no rows. Only doc_id,
    source, text and the row hash are used, so other columns cannot clash.
    """
    rows = stored_keys(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"),
                                   row_hash(docs).alias("_hash")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    targets = targets.withColumns({"_null": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    keyed = rows.withColumns({"_null": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    rated = join_small(keyed, targets.drop("source"), ["_null", "_name"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = ["_null", "_name", "_less", "doc_id", "_hash", "_row"]
    placed, _, _ = numbered(rated.withColumns({"_rate": rate, "_less": -F.col("size")}), order)
    placed = materialize(placed.withColumns({
        "_whole": F.floor("_rate").cast("int"), "_part": F.col("_rate") - F.floor("_rate")}))
    first = placed.groupBy("_null", "_name").agg(F.min("_position").alias("source_no"))
    open_ = join_small(placed.filter("_part > 0 and size > 0"), first, ["_null", "_name"])
    units = open_.select("source_no", F.expr(f"(_position - source_no) div {GROUP}").alias("group"),
                         F.col("_position").alias("at"), F.col("_part").alias("p"), "size", "source_size")
    largest = materialize(_round_largest(units, seed))
    others = join_small(units.filter("group > 0").drop("p"), largest.select("source_no", "p"), "source_no")
    settled = largest.select(F.explode("done").alias("d")).select("d.at", "d.take")
    rounded = settled.unionByName(_round_fractions(others.filter("p > 0 and p < 1"), seed)).unionByName(
        others.filter("p = 0 or p = 1").select("at", F.col("p").cast("int").alias("take")))
    rounded = rounded.withColumnRenamed("at", "_position")
    copies = F.col("_whole") + F.coalesce("take", F.lit(0))
    return placed.join(rounded, "_position", "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), "_hash")


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 13) -> DataFrame:
    """The documents as often as the mix takes them, all columns unchanged."""
    keys = mix(docs, weights, most, seed).groupBy("doc_id", "_hash").agg(
        F.count(F.lit(1)).alias("_copies"), F.sum("copies").alias("_times")).filter("_times > 0")
    taken = keep_rows(docs, keys)
    return taken.select("_doc", F.explode(F.expr("sequence(1, int(_times))"))).select("_doc.*")
