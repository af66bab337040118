"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r every bit gets a non-zero label of r + 1 bits; each non-zero vector v
of r + 1 bits makes one mask: the bits whose label has an odd inner product with v. The labels of r differing
bits span at most r dimensions, so some v is orthogonal to all of them: its mask leaves these bits out, and two
fingerprints within the radius agree under that mask. 2^(r+1) - 1 tables therefore lose no pair.

Work is done on distinct fingerprints, so copies cost nothing. A bucket with more than ``BUCKET`` fingerprints
is not compared but dealt again: a second family of masks over the bits that the first left free covers every
pair in it, and again if need be. Distinct fingerprints that agree on all but k bits are at most 2^k, so this
ends after three rounds at most. Buckets give a spanning set of their links, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.components import component_roots
from logtide.llm.rows import keep_rows, row_hash
from logtide.plans.materialize import materialize

#: Most distinct fingerprints that are compared with each other in one task's memory.
BUCKET = 2_048
SEED = 42
_CHUNK = 65_536
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned 64-bit number.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``shingle`` words joined
    by one space, repeats included; with fewer words the whole sequence is the only shingle, without words the
    fingerprint is 0. A bit is set where over half of the shingles' XXH64 have it.
    """
    words = [] if text is None else text.encode().translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle + 1
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        top = min(n, k + _CHUNK)
        spans = zip(starts[k:top].tolist(), ends[k + shingle - 1:top + shingle - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def masks(radius: int, fixed: int = 0) -> list[int]:
    """Covering masks for the bits outside ``fixed``; each keeps the bits of ``fixed``."""
    free = [b for b in range(64) if not fixed >> b & 1]
    labels = {b: k % (2 ** (radius + 1) - 1) + 1 for k, b in enumerate(free)}
    made = [fixed | sum(1 << b for b in free if (labels[b] & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]
    return list(dict.fromkeys(made))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def add_fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``_print``, the fingerprint as a signed long."""
    kinds = {c: t for c, t in docs.dtypes}

    def run(batches):
        for batch in batches:
            prints = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(batch.num_columns - 1)]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(prints, pa.int64())], names=[*keep, "_print"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", _print long"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the given links beside the smallest fingerprint that they connect it with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, least)
        np.minimum.at(after, y, least)
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(prints: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of ``prints``; ``sizes`` are the runs' lengths, none above ``BUCKET``."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    left, right = [], []
    small = (sizes > 1) & (sizes <= 64)
    held = np.repeat(small, sizes)
    p, r = prints[held], run[held]
    for d in range(1, int(sizes[small].max(initial=1))):
        near = (r[d:] == r[:-d]) & (np.bitwise_count(p[d:] ^ p[:-d]) <= radius)
        at = np.flatnonzero(near)
        left.append(p[at])
        right.append(p[at + d])
    starts = np.cumsum(sizes) - sizes
    for k in np.flatnonzero(sizes > 64):
        x = prints[starts[k]: starts[k] + sizes[k]]
        for c in range(0, len(x), 256):
            i, j = np.nonzero(np.bitwise_count(x[c:c + 256, None] ^ x[None, :]) <= radius)
            ahead = i + c < j
            a, b = _star(x[i[ahead] + c], x[j[ahead]])
            left.append(a)
            right.append(b)
    if not left:
        return prints[:0], prints[:0]
    return _star(np.concatenate(left), np.concatenate(right))


def _compare(radius: int, bucket: int):
    """Reads (_mask, _key, _print) sorted by all three; gives links, and the rows of buckets over ``bucket``
    with their next masks. Holds one bucket and one batch at a time."""
    schema = pa.schema([("deep", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])

    def give(deep, a, b, c):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), deep)), pa.array(a), pa.array(b), pa.array(c)],
                                          schema=schema)

    def again(mask, prints):
        for m in masks(radius, int(mask) & (1 << 64) - 1):
            m = np.int64(_signed(m))
            yield give(True, np.full(len(prints), m), prints & m, prints)

    def run(batches):
        mask = key = prints = np.empty(0, np.int64)
        open_deep = None  # (mask, key) of an over-full bucket whose rows are passed on as they come
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            mask, key, prints = (np.concatenate(x) for x in zip((mask, key, prints), columns))
            if open_deep is not None:
                same = int(np.searchsorted(~((mask == open_deep[0]) & (key == open_deep[1])), True))
                yield from again(open_deep[0], prints[:same])
                mask, key, prints = mask[same:], key[same:], prints[same:]
                if not len(prints):
                    continue
                open_deep = None
            edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], edges])
            sizes = np.diff(np.concatenate([starts, [len(prints)]]))
            last = starts[-1]  # the last bucket may go on in the next batch
            yield from part(mask[:last], prints[:last], sizes[:-1])
            if sizes[-1] > bucket:
                open_deep = (mask[last], key[last])
                yield from again(mask[last], prints[last:])
                last = len(prints)
            mask, key, prints = mask[last:], key[last:], prints[last:]
        if len(prints):
            yield from part(mask, prints, np.array([len(prints)]))

    def part(mask, prints, sizes):
        if not len(prints):
            return
        starts = np.cumsum(sizes) - sizes
        full = sizes > bucket
        for k in np.flatnonzero(full):
            yield from again(mask[starts[k]], prints[starts[k]: starts[k] + sizes[k]])
        held = np.repeat(~full, sizes)
        a, b = _links(prints[held].view(np.uint64), sizes[~full], radius)
        yield give(False, a.view(np.int64), b.view(np.int64), np.zeros(len(a), np.int64))

    return run


def links_within(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between fingerprints, enough to connect all that differ in at most ``radius`` bits.

    ``prints`` has one column ``_print`` of distinct longs. ``bucket`` is a plan setting: it does not change
    which fingerprints are connected. It must be at least 256.
    """
    family = F.array(*[F.lit(_signed(m)) for m in masks(radius)])
    dealt = prints.select("_print", F.explode(family).alias("_mask")).select(
        "_mask", F.col("_print").bitwiseAND(F.col("_mask")).alias("_key"), "_print")
    links = None
    while True:
        sorted_ = dealt.repartition("_mask", "_key").sortWithinPartitions("_mask", "_key", "_print")
        found = materialize(sorted_.mapInArrow(_compare(radius, bucket), "deep boolean, a long, b long, c long"))
        own = found.filter("not deep").select("a", "b")
        links = own if links is None else links.unionByName(own)
        deep = found.filter("deep")
        if deep.isEmpty():
            return links
        dealt = deep.select(F.col("a").alias("_mask"), F.col("b").alias("_key"), F.col("c").alias("_print")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, bucket: int = BUCKET,
                    keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, _print (fingerprint as signed long) and component_id.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest
    doc_id that links reach, the own one included. A null text has no words: fingerprint 0, linked like any
    other. Rows with a null doc_id take part in links, but null is never the smallest; it is the component_id
    only where no document reached has an id. Repeated rows share a component. An empty table gives no rows.
    Only ``keep`` and text are read, so other columns cannot clash.
    """
    return _marked(docs, shingle, radius, bucket, keep).drop("_root")


def _marked(docs: DataFrame, shingle: int, radius: int, bucket: int, keep: tuple[str, ...]) -> DataFrame:
    prints = materialize(add_fingerprints(docs, shingle, keep))
    distinct = materialize(prints.groupBy("_print").agg(F.min("doc_id").alias("_least")))
    roots = component_roots(links_within(distinct.select("_print"), radius, bucket))
    rooted = distinct.join(roots, distinct["_print"] == roots["node"], "left").select(
        "_print", "_least", F.coalesce("root", "_print").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    component = rooted.join(least, "_root").select("_print", "_root", "component_id")
    return prints.join(component, "_print").select(*keep, "_print", "_root", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component, all columns unchanged: the one whose doc_id names the component.

    Of several rows with that doc_id in the component, the one with the smallest row hash stays.
    """
    marked = _marked(docs.select("doc_id", "text", row_hash(docs).alias("_hash")), shingle, radius, BUCKET,
                     ("doc_id", "_hash"))
    return keep_named(docs, marked)


def keep_named(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component in ``marked`` (doc_id, _hash, _root, component_id)."""
    named = marked.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = named.groupBy("_root", "doc_id", "_hash").agg(F.count(F.lit(1)).alias("_copies"))
    first = rows.groupBy("_root").agg(F.min(F.struct("_hash", "doc_id", "_copies")).alias("first"))
    return keep_rows(docs, first.select("first.doc_id", "first._hash", "first._copies")).select(
        "_doc.*")


def to_hex(signed: str) -> Column:
    """Sixteen lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(signed), 16, "0"))
