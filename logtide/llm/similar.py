"""Near-duplicates by exact Jaccard similarity of word shingles; SimHash fingerprints and minimum hashes find candidates.

Sets whose texts' fingerprints are linked within ``RADIUS`` bits (covering masks of ``simhash``) are one group. As pairs of
0.8 mostly differ in more bits, every set also gets ``BANDS * ROWS`` minimum hashes, and those that agree in a band are a
group: two sets of similarity s agree in one hash with probability s, and all of a band with probability s ** ROWS. A pair
of 0.8 meets in none of the bands with probability (1 - 0.8 ** 5) ** 48 < 6e-9. What a set costs does not depend on how
common its shingles are: sets that only share a passage hardly ever meet, in whichever number they come.

Work is done on distinct sets. In a group each set is first compared with the group's least node, which is the same one in
most bands, so that n near copies cost few more than n comparisons. Comparisons take the whole sets; the least node's set
is sent once for each ``PARTNERS`` of its partners. Where sets that met the same least node are not connected by then, they
are compared with each other by counting what they have in common, in tasks of two cells of bounded size; only links leave
a task. Shingles, and sets as nodes, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.batches import slices
from logtide.llm.components import component_roots
from logtide.llm.rows import row_hash
from logtide.llm.simhash import SEED, _FOLD, _signed, _star, fingerprint, keep_named, links_within
from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize, release

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 48, 5
#: Bits in which the fingerprints of candidates differ at most.
RADIUS = 3
#: Sets in a cell, and their shingles; a task compares two cells.
NEIGHBOURS, CELL = 1_024, 1_000_000
#: Shingles in more sets of a task than these are counted by products of matrices of ``_WIDE`` columns.
_RARE, _WIDE = 64, 512
#: Partners of a set in one task, and most links (16 bytes each) that one task unites.
PARTNERS, ONE_TASK = 256, 500_000
#: Shingles that are hashed anew at once.
_CHUNK = 2_048
_FACTORS, _SHIFTS, _WEIGHTS = (
    np.random.default_rng(SEED).integers(0, 2 ** 64, (3, BANDS * ROWS), np.uint64) | np.array([[1], [0], [1]], np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingles as sorted hashes: ``words`` words with A-Z lower-cased, the whole text where it has fewer.

    Texts without words have one shingle, the empty one.
    """
    found = [] if text is None else text.encode().translate(_FOLD).split()
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[: len(found) - words + 1].tolist(), ends[words - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64).view(np.int64))


def _node(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Key of each band: a hash of the band's minimum hashes and its number."""
    least = np.full(BANDS * ROWS, 2 ** 64 - 1, np.uint64)
    own = shingles.view(np.uint64)
    for k in range(0, len(own), _CHUNK):
        np.minimum(least, (own[k:k + _CHUNK, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    # the places keep the bands apart; the high half is mixed into the low one before the sum
    mixed = (least ^ least >> np.uint64(32)) * _WEIGHTS
    keys = mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return (keys ^ keys >> np.uint64(29)).view(np.int64)


def _sketched(docs: DataFrame, words: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, _text (hash of the text), _node, _n (shingles), _print and _bands; a task gives a set's last two once."""
    kinds = {c: t for c, t in docs.dtypes}

    def run(batches):
        seen = set()
        at = len(keep) + 1
        for batch in batches:
            for part in slices(batch, at):
                nodes, sizes, prints, bands = [], [], [], []
                for text in part.column(at):
                    own = shingle_set(text.as_py(), words)
                    node = _node(own)
                    nodes.append(node)
                    sizes.append(len(own))
                    prints.append(None if node in seen else _signed(fingerprint(text.as_py())))
                    bands.append(None if node in seen else band_keys(own))
                    seen.add(node)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()),
                     pa.array(bands, pa.list_(pa.int64()))], names=[*keep, "_text", "_node", "_n", "_print", "_bands"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", _text long, _node long, _n int, _print long, _bands array<long>"
    return docs.select(*keep, F.xxhash64("text").alias("_text"), "text").mapInArrow(run, schema)


def _fits(n, m, similarity: float):
    """True where sets of ``n`` and ``m`` shingles can be similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _whole_sets(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(node, set) of the asked (node, _text), one text for each."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingle_set(t.as_py(), words).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    rows = join_small(docs.select("text", F.xxhash64("text").alias("_text")), asked, "_text", "inner")
    return rows.select("node", "text").dropDuplicates(["node"]).mapInArrow(run, "node long, set binary")


def _similar(similarity: float):
    """Reads (a, part, b, set), for every part the set of a itself first, b being null; gives the similar pairs."""
    def run(batches):
        hub = None
        for batch in batches:
            left, right = [], []
            for a, b, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = np.frombuffer(data.as_buffer(), np.int64)
                if b is None:
                    hub = own
                    continue
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if both / (len(hub) + len(own) - both) >= similarity:
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _linked(sets: list[np.ndarray], roots: np.ndarray, left: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the similar pairs of different roots: among all ``sets``, or with ``left``, of one before that and one behind."""
    sizes = np.array([len(x) for x in sets])
    kinds, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    last, first = left or len(sets), left
    both = np.zeros((last, len(sets) - first), np.float32)
    rare = count[number] <= _RARE
    order = np.argsort(number[rare], kind="stable")
    n, own = number[rare][order], owner[rare][order]
    for d in range(1, int(count[count <= _RARE].max(initial=1))):
        at = np.flatnonzero((n[d:] == n[:-d]) & (own[:-d] < last) & (own[d:] >= first))
        np.add.at(both, (own[at], own[at + d] - first), 1)
    column = np.cumsum(count > _RARE) - 1
    order = np.argsort(column[number[~rare]], kind="stable")
    n, own = column[number[~rare]][order], owner[~rare][order]
    for k in range(0, int(column[-1]) + 1, _WIDE):
        some = slice(*np.searchsorted(n, [k, k + _WIDE]))
        table = np.zeros((len(sets), _WIDE), np.float32)
        table[own[some], n[some] - k] = 1
        both += table[:last] @ table[first:].T
    x, y = [], []
    for k in range(0, last, 256):
        part = both[k:k + 256].astype(float)
        near = part / (sizes[k:min(k + 256, last), None] + sizes[first:] - part) >= similarity
        i, j = np.nonzero(near & (roots[k:min(k + 256, last), None] != roots[first:]))
        ahead = i + k < j + first  # within one cell each pair once
        x.append(i[ahead] + k)
        y.append(j[ahead] + first)
    return np.concatenate(x), np.concatenate(y)


def _compared(similarity: float):
    """Reads (a, tile, side, node, root, set) sorted by the first four; gives links that connect each tile's similar sets.

    A tile has one cell, or two that differ in ``side`` and are compared with each other only. Holds one tile and a batch.
    """
    def links(held):
        side, node, root, sets = zip(*held)
        if len(set(root)) == 1:
            return
        node = np.array(node)
        i, j = _linked(sets, np.array(root), side.index(1) if side[-1] else 0, similarity)
        if len(i):
            b, a = _star(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            for *tile, side, node, root, data in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                if tile != at:
                    if held:
                        yield from links(held)
                    held, at = [], tile
                held.append((side, node, root, np.frombuffer(data.as_buffer(), np.int64).copy()))
        if held:
            yield from links(held)

    return run


def _verified(docs: DataFrame, whole: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose ``whole`` sets are similar, stored."""
    salt = F.lit(PARTNERS).cast("long")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / salt).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    partners = pairs.join(hubs, "a").select("a", part, "b").join(whole.select(F.col("node").alias("b"), "set"), "b")
    own = hubs.select(F.col("a").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(
        whole, "node").select(F.col("node").alias("a"), F.col("part").cast("int").alias("part"),
                              F.lit(None).cast("long").alias("b"), "set")
    beside = own.unionByName(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return materialize(beside.select("a", "part", "b", "set").mapInArrow(_similar(similarity), "a long, b long"))


def _among(whole: DataFrame, met: DataFrame, roots: DataFrame, similarity: float, neighbours: int) -> DataFrame:
    """Links that connect the similar sets among those that met the same least node and that ``roots`` do not connect."""
    rooted = met.select("a", "node", "n").join(roots, "node", "left").select("a", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("a").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.ceil(F.greatest(F.count(F.lit(1)) / neighbours, F.sum("n") / CELL)).cast("int").alias("cells")).filter("lo <> hi")
    cell = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    dealt = rooted.join(mixed.select("a", "cells"), "a").select(
        "a", "node", "root", "cells", cell.alias("cell"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    tile = F.least("cell", "other").cast("long") * F.col("cells") + F.greatest("cell", "other")
    tiles = dealt.select("a", tile.alias("tile"), (F.col("cell") > F.col("other")).cast("int").alias("side"), "node", "root")
    rows = tiles.join(whole, "node").repartition("a", "tile").sortWithinPartitions("a", "tile", "side", "node")
    return materialize(rows.select("a", "tile", "side", "node", "root", "set").mapInArrow(_compared(similarity), "a long, b long"))


def _printed(sets: DataFrame) -> DataFrame:
    """(key, n, node): sets whose fingerprints are linked within ``RADIUS`` bits have one key."""
    near = component_roots(links_within(sets.select("_print").distinct(), RADIUS), ONE_TASK)
    return sets.join(near, sets["_print"] == near["node"], "left").select(
        F.coalesce("root", "_print").alias("key"), F.col("_n").alias("n"), F.col("_node").alias("node"))


def similar_roots(docs: DataFrame, sets: DataFrame, words: int, similarity: float, neighbours: int) -> DataFrame:
    """(node, root) for the sets that links of ``similarity`` or more lead to a smaller node from.

    ``sets`` has one row (_node, _text, _n, _print, _bands) for each distinct set. ``neighbours`` is a plan setting.
    """
    dealt = sets.select(F.explode("_bands").alias("key"), F.col("_n").alias("n"), F.col("_node").alias("node"))
    dealt = dealt.unionByName(_printed(sets))
    least = F.min(F.struct("node", "n"))
    shared = dealt.groupBy("key").agg(least.alias("hub"), F.max("node").alias("_last")).filter("hub.node <> _last")
    met = materialize(dealt.join(shared.select("key", "hub"), "key").filter(F.col("node") != F.col("hub.node")).select(
        F.col("hub.node").alias("a"), F.col("hub.n").alias("m"), "node", "n").distinct())
    asked = met.select("node").unionByName(met.select(F.col("a").alias("node"))).distinct()
    named = materialize(sets.select(F.col("_node").alias("node"), "_text").join(asked, "node"))
    whole = materialize(_whole_sets(docs, named, words))
    release(named)
    links = _verified(docs, whole, met.filter(_fits(F.col("n"), F.col("m"), similarity)).select("a", F.col("node").alias("b")), similarity)
    roots = component_roots(links, ONE_TASK)
    among = _among(whole, met, roots, similarity, neighbours)
    if not among.isEmpty():  # the roots so far stand for all links that led to them
        roots = component_roots(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(among), ONE_TASK)
    release(whole)
    release(met)
    return roots


def _marked(docs: DataFrame, words: int, similarity: float, neighbours: int, keep: tuple[str, ...]) -> DataFrame:
    rows = materialize(_sketched(docs, words, keep))
    sets = materialize(rows.groupBy("_node").agg(
        F.min("doc_id").alias("_least"), F.min("_text").alias("_text"), F.first("_n").alias("_n"),
        F.min("_print").alias("_print"), F.first("_bands", ignorenulls=True).alias("_bands")))
    roots = similar_roots(docs, sets, words, similarity, neighbours)
    rooted = sets.join(roots, sets["_node"] == roots["node"], "left").select(
        "_node", "_least", F.coalesce("root", "_node").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    component = rooted.join(least, "_root").select("_node", "_root", "component_id")
    return rows.select(*keep, "_node").join(component, "_node").select(*keep, "_root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, neighbours: int = NEIGHBOURS,
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` and component_id, the smallest doc_id that links reach, the own one included.

    Documents are linked where the Jaccard similarity of their shingle sets is at least ``similarity``. Null texts,
    null ids, repeated rows and empty tables are taken as by ``simhash.near_duplicates``.
    """
    return _marked(docs, words, similarity, neighbours, keep).drop("_root")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component, all columns unchanged; which one, as in ``simhash.drop_near_duplicates``."""
    rows = docs.select("doc_id", "text", row_hash(docs).alias("_hash"))
    return keep_named(docs, _marked(rows, words, similarity, NEIGHBOURS, ("doc_id", "_hash")))
