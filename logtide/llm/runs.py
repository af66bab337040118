"""Periodic runs of words: maximal stretches that repeat with a period, and texts with the repeats cut out.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of at least 2q that
no neighbouring word extends. Its first word s and the word s + q start suffixes with a longest common prefix
(LCP) of exactly length - q >= q words, and no position between them starts a suffix that shares as much. So the
suffixes of a text are united in classes by decreasing LCP, as Kruskal's algorithm takes edges: a union-find over
neighbours in the suffix array, each class with the ordered set of its positions, the smaller set going into the
larger one. Two positions that become neighbours in a set at LCP l and lie d <= l apart seed a run of period d and
length d + l; it is the run itself where the words before the two differ. Every run is seeded once.

A run of ``least`` or more words has an LCP of at least ``least / 2``, so only positions whose next ``least / 2``
words occur twice in the text take part; the others are cut away before suffixes are sorted.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm.batches import slices

#: Fewest words of a run.
LEAST = 12
#: Positions in a block of an ordered set; a full block is halved.
_BLOCK = 1_024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of anything but ASCII white space (space, tab to carriage return)."""
    return [] if text is None else text.encode().split()


class Positions:
    """Ordered set of positions in blocks, so that an insertion moves one block only."""

    def __init__(self, position: int):
        self.blocks, self.heads, self.size = [[position]], [position], 1

    def add(self, position: int) -> tuple[int, int]:
        """Puts a new position in; gives the ones before and behind it, -1 where there is none."""
        at = max(0, bisect_left(self.heads, position) - 1)
        block = self.blocks[at]
        k = bisect_left(block, position)
        ahead = block[k - 1] if k else -1
        behind = block[k] if k < len(block) else self.heads[at + 1] if at + 1 < len(self.heads) else -1
        block.insert(k, position)
        self.heads[at] = block[0]
        self.size += 1
        if len(block) > _BLOCK:
            half = block[_BLOCK // 2:]
            del block[_BLOCK // 2:]
            self.blocks.insert(at + 1, half)
            self.heads.insert(at + 1, half[0])
        return ahead, behind

    def __iter__(self):
        for block in self.blocks:
            yield from block


def _repeated(codes: np.ndarray, text_of: np.ndarray, window: int) -> np.ndarray:
    """Positions whose next ``window`` words, all of one text, may occur again in it (hashes decide: no false no)."""
    n = len(codes) - window + 1
    if n < 2:
        return np.empty(0, np.int64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    key = text_of[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(window):
        key = key * np.uint64(0x100000001B3) + mixed[k:n + k]
    whole = np.flatnonzero(text_of[:n] == text_of[window - 1:])
    key = key[whole]
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    at = np.searchsorted(twice, key).clip(max=len(twice) - 1)
    return whole[twice[at] == key]


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Rank of each row among the distinct rows, from 0."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _suffix_edges(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, common): neighbours in suffix order and the length of their common prefix, where it is not 0.

    Prefix doubling; ``symbols`` below 0 are unlike everything, themselves elsewhere included.
    """
    n = len(symbols)
    rank = _ranks([symbols])
    alone = symbols < 0
    rank[alone] = rank.max(initial=0) + 1 + np.arange(int(alone.sum()))
    levels, width = [rank], 1
    while width < n:
        # a suffix that is alone already stays so; what lies behind the end is -1
        order = np.argsort(rank, kind="stable")
        if not (rank[order][1:] == rank[order][:-1]).any():
            break
        further = np.full(n, -1, np.int64)
        further[: n - width] = rank[width:]
        rank = _ranks([rank, further])
        levels.append(rank)
        width *= 2
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1], order[1:]
    common, width = np.zeros(max(0, n - 1), np.int64), 1 << (len(levels) - 1)
    for level in reversed(levels):
        a, b = left + common, right + common
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[level[a[inside]] == level[b[inside]]]
        common[same] += width
        width //= 2
    some = common > 0
    return left[some], right[some], common[some]


def _seeds(left: list[int], right: list[int], common: list[int], place: list[int]):
    """(first, second, LCP) of positions that become neighbours in a class no further apart than their LCP.

    Edges come by decreasing ``common``; ``place`` gives a suffix's position in its text.
    """
    parent = list(range(len(place)))
    held: list[Positions | None] = [None] * len(place)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, length in zip(left, right, common):
        a, b = find(a), find(b)
        big = held[a] or Positions(place[a])
        small = held[b] or Positions(place[b])
        if big.size < small.size:
            a, b, big, small = b, a, small, big
        before, next_ = -1, -1  # the last position put in, and what of the larger set lay behind it
        for p in small:
            ahead, behind = big.add(p)
            if ahead != before:
                if next_ >= 0 and next_ - before <= length:
                    yield before, next_, length
                if ahead >= 0 and p - ahead <= length:
                    yield ahead, p, length
            before, next_ = p, behind
        if next_ >= 0 and next_ - before <= length:
            yield before, next_, length
        parent[b], held[a], held[b] = a, big, None


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every text, by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if sizes.max(initial=0) < least:
        return found
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    text_of = np.repeat(np.arange(len(texts)), sizes)
    window = max(1, -(-least // 2))
    at = _repeated(codes, text_of, window)
    if not len(at):
        return found
    grams = _ranks([text_of[at], *[codes[at + k] for k in range(window)]])
    # stretches of positions that take part, with a symbol of its own behind each
    gap = np.concatenate([(at[1:] != at[:-1] + 1) | (text_of[at[1:]] != text_of[at[:-1]]), [True]])
    slot = np.arange(len(at)) + np.concatenate([[0], np.cumsum(gap)[:-1]])
    symbols = np.full(len(at) + int(gap.sum()), -1, np.int64)
    symbols[slot] = grams
    place = np.full(len(symbols), -1, np.int64)
    place[slot] = at
    left, right, common = _suffix_edges(symbols)
    common = common + window - 1  # in words
    order = np.argsort(-common, kind="stable")
    for first, second, length in _seeds(*(x[order].tolist() for x in (left, right, common)), place.tolist()):
        own = int(text_of[first])
        start = int(starts[own])
        if first > start and codes[first - 1] == codes[second - 1]:
            continue  # the run starts further left
        period = second - first
        if period + length >= least:
            found[own].append((first - start, period + length, period))
    for own in found:
        own.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that lie in no run behind its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length; of several the one that starts first, then the one of smallest period."""
    return min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def add_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST) -> DataFrame:
    """``keep`` columns, n_words, runs (start, length, period in words), longest_run, collapsed, runs_sha256.

    ``runs`` come by start and period; ``collapsed`` is the text without the words that lie in a run behind its first
    period, joined by one space; ``runs_sha256`` is that of ``start,length,period`` and a line feed for every run.

    A null text has no words, as have empty ones: no run, an empty ``collapsed``. Equal rows get equal results, an
    empty table gives no rows, and only ``keep`` and text are read, so no other column can clash. A text is worked
    on in one task; memory grows with it, and with nothing else.
    """
    kinds = {c: t for c, t in docs.dtypes}

    def run(batches):
        at = len(keep)
        for batch in batches:
            for part in slices(batch, at):
                texts = [words_of(t) for t in part.column(at).to_pylist()]
                runs = find_runs(texts, least)
                best = [longest(r) for r in runs]
                named = [[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs]
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array([len(t) for t in texts], pa.int64()), pa.array(named, pa.list_(kind)),
                     pa.array([x and dict(zip(("start", "length", "period"), x)) for x in best], kind),
                     pa.array([b" ".join(collapse(t, r)).decode() for t, r in zip(texts, runs)], pa.string()),
                     pa.array([hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in r).encode()).hexdigest()
                               for r in runs], pa.string())],
                    names=[*keep, "n_words", "runs", "longest_run", "collapsed", "runs_sha256"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(
        run, f"{schema}, n_words long, runs array<{RUN}>, longest_run {RUN}, collapsed string, runs_sha256 string")
