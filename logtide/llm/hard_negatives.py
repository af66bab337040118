"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions. For vectors x and y with angles s and t to one of them,
the angle between x and y is at least |s - t| and at most min(s + t, 2 pi - s - t); the tightest of these over all
references is an interval of the cosine, and times both norms one of the inner product, widened by what rounding can
do. Only vectors whose interval meets a window of asked scores get the integer inner product.

Rows are dealt into blocks of neighbouring directions. An anchor is searched for in its own block first, which gives a
floor for its k best scores; then a block of anchors meets only the blocks whose angles leave room above the floors.
The blocks are sent once for each slice of anchor blocks, the anchors, which are few, to the blocks that they meet.
Positives and negatives are two such searches: the positives' scores are the negatives' windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.plans.materialize import materialize

#: Reference directions; fewest and most rows of a block; anchor blocks that one task compares with a block.
REFERENCES, LEAST_BLOCK, MOST_BLOCK, SLICE = 8, 1_024, 32_768, 64
#: What rounding can do to a bound: this share of the norms' product, and one.
_SLACK = 8e-6
_LARGEST = float(2 ** 62)
_EXACT = float(2 ** 52)
_FIRST, _LAST = -2 ** 63, 2 ** 63 - 1


def finite(vector: str) -> Column:
    """True for arrays without null, infinite or undefined components."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & good, F.lit(False))


def quantised(vector: str, scale: int) -> Column:
    """Components as ``floor(scale * x)``."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def prepare(table: DataFrame, label: Column, vector: Column, usable: Column, anchor: Column) -> DataFrame:
    """(vec_id, label, v, anchor) of the rows that take part, one for each id; of several rows the least counts."""
    rows = table.filter(usable & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("anchor")).filter("label is not null and v is not null")
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("r"))
    return first.select("vec_id", "r.*")


def references(rows: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of ``count`` rows drawn by hash, as rows; which ones only decides how much is left out."""
    found = rows.filter(F.exists("v", lambda x: x != 0)).select("v", F.xxhash64("vec_id").alias("h")).orderBy(
        "h").limit(count).select("v").collect()
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    out = np.zeros((len(found), width))
    for k, r in enumerate(found):
        out[k, :len(r["v"])] = r["v"]
    return out / np.linalg.norm(out, axis=1, keepdims=True) if len(found) else out


@dataclass
class Vectors:
    """Vectors with their ids, labels, norms and angles to the references."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray   # integers
    norms: np.ndarray
    angles: np.ndarray  # vector x reference

    @classmethod
    def make(cls, ids, labels, whole, refs) -> Vectors:
        value = whole.astype(float)
        norms = np.sqrt((value ** 2).sum(axis=1))
        if norms.size and norms.max() ** 2 >= _LARGEST:
            raise ArithmeticError("inner products of these vectors do not fit into 64 bits")
        cosine = value @ refs.T / np.where(norms > 0, norms, 1)[:, None]
        return cls(ids, labels, whole, norms, np.arccos(np.clip(cosine, -1, 1)).astype(np.float32))

    def take(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.whole[at], self.norms[at], self.angles[at])

    def pack(self) -> bytes:
        top = int(np.abs(self.whole).max(initial=0))
        kind = "<i2" if top < 2 ** 15 else "<i4" if top < 2 ** 31 else "<i8"
        head = np.array([len(self.ids), self.whole.shape[1], self.angles.shape[1], int(kind[-1])], "<i8")
        return b"".join([head.tobytes(), self.ids.astype("<i8").tobytes(), self.labels.astype("<i8").tobytes(),
                         self.norms.astype("<f8").tobytes(), self.angles.astype("<f4").tobytes(),
                         self.whole.astype(kind).tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> Vectors:
        n, width, refs, size = np.frombuffer(data, "<i8", 4)
        at, out = 32, []
        for kind, count in (("<i8", n), ("<i8", n), ("<f8", n), ("<f4", n * refs), (f"<i{size}", n * width)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        ids, labels, norms, angles, whole = out
        return cls(ids, labels, whole.reshape(n, width).astype(np.int64), norms, angles.reshape(n, refs))


class Block:
    """A block's rows in the order of their angle to one reference, for windows of angles."""

    def __init__(self, rows: Vectors):
        self.main = int(np.argmin(rows.angles.mean(axis=0))) if rows.angles.size else 0
        self.rows = rows.take(np.argsort(rows.angles[:, self.main], kind="stable")) if rows.angles.size else rows
        self.line = self.rows.angles[:, self.main].astype(float) if rows.angles.size else np.zeros(len(rows.ids))
        self.top = float(self.rows.norms.max(initial=0))
        self.value = self.rows.whole.astype(float)

    def near(self, angles: np.ndarray, norm: float, low: float, high: float) -> np.ndarray:
        """Rows whose inner product with a vector of these angles and norm may lie in [low, high]."""
        reach = norm * self.top
        if reach * (1 + _SLACK) + 1 < low:
            return np.empty(0, np.int64)
        first, last = 0, len(self.line)
        if angles.size and reach > 0 and low > -reach:
            gap = math.acos(min(1.0, max(-1.0, (low - 1 - _SLACK * reach) / reach)))
            if low - 1 - _SLACK * reach > 0:  # a shorter row needs a smaller angle still, a negative product any row
                first = int(np.searchsorted(self.line, angles[self.main] - gap - 1e-6, "left"))
                last = int(np.searchsorted(self.line, angles[self.main] + gap + 1e-6, "right"))
        at = np.arange(first, last)
        if not angles.size or not len(at):
            return at
        own = self.rows.angles[first:last].astype(float)
        least = np.abs(own - angles).max(axis=1)
        both = own + angles
        most = np.minimum(both, 2 * np.pi - both).min(axis=1)
        product = norm * self.rows.norms[first:last]
        slack = _SLACK * product + 1
        return at[(product * np.cos(least) + slack >= low) & (product * np.cos(most) - slack <= high)]

    def scores(self, vector: np.ndarray, norm: float, at: np.ndarray) -> np.ndarray:
        if norm * self.top >= _LARGEST:
            raise ArithmeticError("inner products of these vectors do not fit into 64 bits")
        if norm * self.top < _EXACT:  # all partial sums are integers that a double holds
            return np.rint(self.value[at] @ vector.astype(float)).astype(np.int64)
        return self.rows.whole[at] @ vector


def _bounds(angles: np.ndarray) -> tuple[list[float], list[float]]:
    if not len(angles):
        return [], []
    return angles.min(axis=0).astype(float).tolist(), angles.max(axis=0).astype(float).tolist()


def make_blocks(rows: DataFrame, refs: np.ndarray, most: int = MOST_BLOCK) -> DataFrame:
    """(block, rows, anchors, low, high, top): packed neighbouring rows, the anchors among them, bounds of the angles
    and the largest norm; stored. ``block`` is the id of its first row."""
    width = refs.shape[1]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def place(batches):
        for batch in batches:
            whole = _matrix(batch.column(2), width)
            made = Vectors.make(None, None, whole, refs)
            near = made.angles.argmin(axis=1) if made.angles.size else np.zeros(len(whole), np.int64)
            angle = made.angles[np.arange(len(near)), near] if made.angles.size else np.zeros(len(near), np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(angle)],
                                             names=[*batch.schema.names, "near", "angle"])

    placed = materialize(rows.mapInArrow(place, "vec_id long, label long, v array<long>, anchor boolean, near int, angle float"))
    size = int(min(most, max(LEAST_BLOCK, placed.count() // parts + 1)))

    def pack(batches):
        held: list[pa.RecordBatch] = []
        count = 0

        def give():
            table = pa.Table.from_batches(held).combine_chunks()
            for start in range(0, table.num_rows, size):
                some = table.slice(start, size)
                ids, labels = (some.column(k).to_numpy() for k in (0, 1))
                made = Vectors.make(ids, labels, _matrix(some.column(2).combine_chunks(), width), refs)
                anchors = made.take(np.flatnonzero(some.column(3).to_numpy(zero_copy_only=False)))
                low, high = _bounds(made.angles)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(ids[0])]), pa.array([made.pack()]), pa.array([anchors.pack()]),
                     pa.array([len(anchors.ids)], pa.int32()), pa.array([low], pa.list_(pa.float64())),
                     pa.array([high], pa.list_(pa.float64())), pa.array([float(made.norms.max(initial=0))])],
                    names=["block", "rows", "anchors", "n_anchors", "low", "high", "top"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= size:
                whole = pa.Table.from_batches(held)
                keep = count - count % size
                rest = whole.slice(keep).to_batches()
                held = whole.slice(0, keep).to_batches()
                yield from give()
                held, count = rest, count - keep
        if count:
            yield from give()

    ordered = placed.repartitionByRange(parts, "near", "angle", "vec_id").sortWithinPartitions("near", "angle", "vec_id")
    return materialize(ordered.select("vec_id", "label", "v", "anchor").mapInArrow(
        pack, "block long, rows binary, anchors binary, n_anchors int, low array<double>, high array<double>, top double"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as ending in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(starts, sizes)] = flat
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by falling score and rising id."""
    return np.lexsort((ids, -scores))[:k]


def scan(anchors: Vectors, windows: list[list[list[float]]], block: Block, same: bool, k: int):
    """(anchor, window number, id, score): of every anchor and window [low, high, floor] the ``k`` first of the block.

    ``same`` asks for rows of the anchor's label, else for rows of another one; the anchor itself is left out. Scores
    below the floor may be left out.
    """
    out: tuple[list, list, list, list] = ([], [], [], [])
    for n, own in enumerate(windows):
        if not own:
            continue
        at = block.near(anchors.angles[n], float(anchors.norms[n]), min(max(w[0], w[2]) for w in own),
                        max(w[1] for w in own))
        right = (block.rows.labels[at] == anchors.labels[n]) == same
        at = at[right & (block.rows.ids[at] != anchors.ids[n])]
        if not len(at):
            continue
        ids, scores = block.rows.ids[at], block.scores(anchors.whole[n], float(anchors.norms[n]), at)
        for w, (low, high, floor) in enumerate(own):
            fits = np.flatnonzero((scores >= max(low, floor)) & (scores <= high))
            first = fits[_best(ids[fits], scores[fits], k)]
            for column, values in zip(out, ([int(anchors.ids[n])] * len(first), [w] * len(first), ids[first].tolist(),
                                            scores[first].tolist())):
                column.extend(values)
    return out


_FOUND = "anchor_id long, window int, id long, score long"


def _batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int32()),
                                       pa.array(found[2], pa.int64()), pa.array(found[3], pa.int64())],
                                      names=["anchor_id", "window", "id", "score"])


def search(blocks: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, id, score, place): the ``k`` first rows of every window of every anchor.

    ``asked``: (block, anchors, windows), the packed anchors of a block and for each of them its windows [low, high]
    by falling bounds.
    """
    def at_home(batches):
        for batch in batches:
            for number, rows, packed, windows in zip(*(c.to_pylist() for c in batch.columns)):
                anchors, block = Vectors.unpack(packed), Block(Vectors.unpack(rows))
                open_ = [[[*w, _FIRST] for w in own] for own in windows]
                found = scan(anchors, open_, block, same, k)
                kth: dict[tuple[int, int], list[int]] = {}
                for a, w, _, s in zip(*found):
                    kth.setdefault((a, w), []).append(s)
                floors = [[[lo, hi, min(got) if len(got := kth.get((int(a), w), [])) == k else _FIRST]
                           for w, (lo, hi, _) in enumerate(own)] for a, own in zip(anchors.ids, open_)]
                least = float(min((max(w[0], w[2]) for own in floors for w in own), default=_LAST))
                low, high = _bounds(anchors.angles)
                cells = pa.list_(pa.struct([("anchor_id", pa.int64()), ("window", pa.int32()), ("id", pa.int64()),
                                            ("score", pa.int64())]))
                names = ("anchor_id", "window", "id", "score")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([packed]), pa.array([floors], pa.list_(pa.list_(pa.list_(pa.int64())))),
                     pa.array([least]), pa.array([low], pa.list_(pa.float64())), pa.array([high], pa.list_(pa.float64())),
                     pa.array([float(anchors.norms.max(initial=0))]),
                     pa.array([[dict(zip(names, r)) for r in zip(*found)]], cells)],
                    names=["a", "anchors", "windows", "least", "a_low", "a_high", "a_top", "found"])

    home = materialize(blocks.select("block", "rows").join(asked, "block").select(
        "block", "rows", "anchors", "windows").mapInArrow(at_home, """a long, anchors binary,
        windows array<array<array<long>>>, least double, a_low array<double>, a_high array<double>, a_top double,
        found array<struct<anchor_id: long, window: int, id: long, score: long>>"""))
    slices = max(1, math.ceil(home.count() / SLICE))
    part = F.pmod(F.xxhash64("a"), F.lit(slices)).cast("int").alias("part")
    # which blocks leave room above the floors: one narrow row for each block and slice meets the slice's anchor blocks
    spread = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part")
    narrow = blocks.select(F.col("block").alias("b"), "low", "high", "top", spread)
    met = narrow.join(home.select("a", "least", "a_low", "a_high", "a_top", part), "part").filter("a <> b")
    gap = F.aggregate(F.arrays_zip("low", "high", "a_low", "a_high"), F.lit(0.0), lambda s, x: F.greatest(
        s, x["a_low"] - x["high"], x["low"] - x["a_high"]))
    reach = F.col("a_top") * F.col("top")
    room = reach * F.greatest(F.cos(F.least(gap, F.lit(math.pi / 2))), F.lit(0.0)) + reach * _SLACK + 1
    pairs = materialize(met.filter(room >= F.col("least")).select("b", "part", "a"))
    sent = home.join(pairs, "a").select("b", "part", F.lit(1).alias("kind"), "a", F.col("anchors").alias("data"), "windows")
    whole = blocks.join(pairs.select(F.col("b").alias("block"), "part").distinct(), "block").select(
        F.col("block").alias("b"), "part", F.lit(0).alias("kind"), F.col("block").alias("a"), F.col("rows").alias("data"),
        F.lit(None).cast("array<array<array<long>>>").alias("windows"))

    def meet(batches):
        held = None
        for batch in batches:
            for k_, data, windows in zip(*(c.to_pylist() for c in batch.select(["kind", "data", "windows"]).columns)):
                if k_ == 0:
                    held = Block(Vectors.unpack(data))
                else:
                    yield _batch(scan(Vectors.unpack(data), windows, held, same, k))

    ordered = whole.unionByName(sent).repartition("b", "part").sortWithinPartitions("b", "part", "kind", "a")
    found = ordered.mapInArrow(meet, _FOUND).unionByName(
        home.select(F.explode("found").alias("f")).select("f.*"))
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   count: int = REFERENCES, most: int = MOST_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` as made by ``prepare``. An anchor's positives are the first ``positives`` other rows of its label by
    falling inner product and rising id; for each of them the first ``negatives`` rows of another label whose score n
    and the positive's score p fulfil low * p <= 100 * n <= high * p, ranked from 1. ``count`` and ``most`` (references,
    largest block) are plan settings.

    Ids are unique after ``prepare``: repeated rows count once. Vectors shorter than the longest end in zeros; vectors of
    zeros score 0 with every row. Anchors without positives or a positive without negatives give no row, as do an
    empty table and one without anchors. A table whose inner products may pass 62 bits is refused with
    ArithmeticError.
    """
    rows = materialize(rows.select("vec_id", "label", "v", "anchor"))
    blocks = make_blocks(rows, references(rows, count), most)
    some = blocks.filter("n_anchors > 0")
    every = F.array(F.lit(_FIRST), F.lit(_LAST))
    asked = some.select("block", "anchors", F.array_repeat(F.array(every), F.col("n_anchors")).alias("windows"))
    best = materialize(search(blocks, asked, True, positives).select(
        "anchor_id", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score")))
    score, hundred = F.col("positive_score").cast("decimal(30,0)"), F.lit(100).cast("decimal(3,0)")
    least, largest = score * F.lit(low).cast("decimal(3,0)"), score * F.lit(high).cast("decimal(3,0)")
    window = F.array(((least + F.pmod(-least, hundred)) / 100).cast("long"), ((largest - F.pmod(largest, hundred)) / 100).cast("long"))
    own = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", window.alias("w")))).alias("w"))
    listed = some.select("block", "anchors").mapInArrow(_anchor_places, "block long, anchor_id long, at int")
    listed = listed.join(own, "anchor_id", "left").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce(F.transform("w", lambda x: x["w"]), F.array().cast(
            "array<array<long>>")).alias("w")))).alias("l"))
    asked = some.select("block", "anchors").join(listed, "block").select(
        "block", "anchors", F.transform("l", lambda x: x["w"]).alias("windows"))
    wide = search(blocks, materialize(asked), False, negatives)
    return wide.join(best, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def _anchor_places(batches):
    for batch in batches:
        for number, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = Vectors.unpack(packed).ids
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(ids), pa.int64()), pa.array(ids), pa.array(np.arange(len(ids), dtype=np.int32))],
                names=["block", "anchor_id", "at"])
