"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to ``ORDER`` bytes is counted: after each context the bytes seen and
how often. A byte costs -log2 of its share after the longest known context; a context that is known but has not
seen the byte costs an escape - as likely as it has different bytes to offer (method C) - and the next shorter
context is asked, down to 8 bits for a byte never seen. The statistics are frozen, so the cost of each byte string
of a context and its byte is a constant of the model, and the length of a text's code under a language is a sum of
table look-ups. The language with the shortest code is predicted.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.batches import slices
from logtide.llm.samples import drawn, fold
from logtide.plans.bounded import join_small
from logtide.plans.materialize import materialize

#: Longest context in bytes; a context and its byte must fit into seven.
ORDER = 3
#: About so many documents per language are counted, and of all languages together.
DOCS_PER_LANGUAGE, DOCS = 2_000, 20_000
#: Most byte strings times languages in the model; contexts get shorter, for all languages alike, until it has no more.
CELLS = 4_000_000
#: Positions that are looked up at once.
_CHUNK = 1 << 16


def _key(gram: bytes) -> int:
    return int.from_bytes(gram, "big") << 8 | len(gram)


def _gram(key: int) -> bytes:
    return (key >> 8).to_bytes(key & 255, "big")


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each byte string of 1 to ``order + 1`` bytes occurs in the texts of a language."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                texts = defaultdict(list)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts[lang].append(text.encode())
                for lang, own in texts.items():
                    data = np.frombuffer(b"".join(own), dtype=np.uint8).astype(np.uint64)
                    document = np.repeat(np.arange(len(own)), [len(t) for t in own])
                    key = np.zeros(len(data), dtype=np.uint64)
                    for k in range(order + 1):
                        if len(data) <= k:
                            break
                        key = key[: len(data) - k] << np.uint64(8) | data[k:]
                        whole = document[k:] == document[: len(data) - k]
                        grams, n = np.unique(key[whole] << np.uint64(8) | np.uint64(k + 1), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)),
                             pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class ContextTrees:
    """Frozen model: byte strings as a tree, and per language the cost of each string's last byte and the escape."""

    languages: list[str]
    order: int
    symbol: np.ndarray   # byte -> symbol, 0 for bytes never seen
    parent: np.ndarray   # node -> node of the string without its last byte; node 0 is "unknown", 1 the empty string
    last: np.ndarray     # node -> symbol of its last byte
    cost: np.ndarray     # node x language: bits of the last byte after the bytes before it
    escape: np.ndarray   # node x language: bits of leaving this context; 0 where it is not known

    @classmethod
    def from_counts(cls, counts: dict[str, dict[bytes, int]], order: int) -> ContextTrees:
        languages = sorted(counts)
        grams = sorted({g for own in counts.values() for g in own}, key=lambda g: (len(g), g))
        known = {b""}
        grams = [g for g in grams if g[:-1] in known and not known.add(g)]
        node = {b"": 1} | {g: k + 2 for k, g in enumerate(grams)}
        symbol = np.zeros(256, np.int64)
        for k, b in enumerate(sorted({g[0] for g in grams if len(g) == 1})):
            symbol[b] = k + 1
        cost = np.zeros((len(grams) + 2, len(languages)), np.float32)
        escape = np.zeros_like(cost)
        for at, lang in enumerate(languages):
            own = {g: n for g, n in counts[lang].items() if g in node}
            total, kinds = defaultdict(int), defaultdict(int)
            for g, n in own.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            leave = {c: float(np.log2((total[c] + kinds[c]) / kinds[c])) for c in total}
            bits = {b"": 8.0}
            for g in grams:  # shorter ones first, so the next shorter context is always there
                if g in own:
                    bits[g] = float(np.log2((total[g[:-1]] + kinds[g[:-1]]) / own[g]))
                else:
                    bits[g] = leave.get(g[:-1], 0.0) + (bits[g[1:]] if g[1:] in bits else _shorter(g[1:], bits, leave))
                cost[node[g], at] = bits[g]
            for c, b in leave.items():
                escape[node[c], at] = b
        return cls(languages, order, symbol, np.array([0, 0, *[node[g[:-1]] for g in grams]]),
                   np.array([0, 0, *[symbol[g[-1]] for g in grams]]), cost, escape)

    def table(self) -> np.ndarray:
        """node x symbol -> node; rows only for nodes with children, the others share row 0."""
        width = int(self.symbol.max(initial=0)) + 1
        inner = np.unique(self.parent[2:])
        self.row = np.zeros(len(self.parent), np.int64)
        self.row[inner] = np.arange(1, len(inner) + 1)
        children = np.zeros((len(inner) + 1, width), np.int32)
        children[self.row[self.parent[2:]], self.last[2:]] = np.arange(2, len(self.parent))
        return children

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text under every language."""
        if not hasattr(self, "children"):
            self.children = self.table()
        out = np.zeros((len(texts), len(self.languages)))
        gap, stops, pieces = b"\0" * self.order, [], []
        for k, text in enumerate(texts):  # long texts in pieces that overlap by a context
            for start in range(0, len(text), _CHUNK):
                pieces.append((k, text[max(0, start - self.order):start + _CHUNK], min(start, self.order)))
        block, held = [], 0
        for piece in pieces:
            block.append(piece)
            held += len(piece[1])
            if held >= _CHUNK:
                self._add(block, gap, out)
                block, held = [], 0
        if block:
            self._add(block, gap, out)
        return out

    def _add(self, block, gap: bytes, out: np.ndarray) -> None:
        """Adds the costs of pieces (text number, bytes, leading bytes that only are context)."""
        data = np.frombuffer(gap + gap.join(p for _, p, _ in block), dtype=np.uint8)
        symbols = self.symbol[data]
        starts = np.cumsum([len(gap), *[len(p) + len(gap) for _, p, _ in block[:-1]]])
        ends = starts + [len(p) for _, p, _ in block]
        for s in starts:  # what lies between texts is unknown to every context
            symbols[s - len(gap):s] = 0
        node = self.children[self.row[1]][symbols]
        price = self.escape[1] + 8.0
        cost = np.where((node > 0)[:, None], self.cost[node], price)
        for k in range(1, self.order + 1):
            context, at = node[:-1], slice(k, None)
            node = self.children[self.row[context], symbols[at]]
            cost[at] = np.where((node > 0)[:, None], self.cost[node], cost[at] + self.escape[context])
        sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        ahead = np.array([c for _, _, c in block])
        np.add.at(out, [k for k, _, _ in block], sums[ends] - sums[starts + ahead])


def _shorter(gram: bytes, bits: dict, leave: dict) -> float:
    """Bits of a string's last byte where the string itself is not in the model."""
    while gram and gram not in bits:
        rest = leave.get(gram[:-1], 0.0)
        return rest + _shorter(gram[1:], bits, leave)
    return bits[gram]


def order_that_fits(grams: DataFrame, order: int, cells: int) -> int:
    """The longest context up to ``order`` under which strings times languages are at most ``cells``; 0 at least."""
    length = F.col("gram").bitwiseAND(F.lit(255))
    languages = grams.select("lang").distinct().count()
    strings = dict(grams.select("gram", length.alias("k")).distinct().groupBy("k").count().collect())
    while order and languages * sum(n for k, n in strings.items() if k <= order + 1) > cells:
        order -= 1
    return order


def fit(docs: DataFrame, order: int = ORDER, docs_per_language: int = DOCS_PER_LANGUAGE, sample: int = DOCS,
        cells: int = CELLS) -> ContextTrees:
    """Model of the languages of ``docs`` (lang, text), from about ``docs_per_language`` texts of each, and not more
    than ``sample`` in all.

    The share drawn is of a language's distinct texts, and each drawn text counts once, however many copies it has.
    Every byte string of the drawn texts up to the model's order is kept, so totals and escapes are those of the
    whole trees; what comes to the driver is bounded by ``cells``.
    """
    rows = docs.filter("lang is not null and text is not null").select(
        F.col("lang").alias("lang"), "text", F.xxhash64("text").alias("_hash"))
    texts = materialize(rows.select("lang", "_hash").distinct())
    each = min(docs_per_language, sample / max(1, texts.select("lang").distinct().count()))
    shares = texts.groupBy("lang").agg((F.lit(float(each)) / F.count(F.lit(1))).alias("_share"))
    rows = join_small(rows, shares, "lang").filter(drawn(F.col("_share"), "_hash")).dropDuplicates(["lang", "_hash"])
    grams = materialize(count_grams(rows, order))
    order = order_that_fits(grams, order, cells)
    counts: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in grams.filter(F.col("gram").bitwiseAND(F.lit(255)) <= order + 1).toLocalIterator():
        counts[r["lang"]][_gram(r["gram"])] = r["n"]
    return ContextTrees.from_counts(dict(counts), order)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: ContextTrees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (share of the best language when all are as likely beforehand).

    A text that is null or has no letter is ``und`` with score 0, and so is every text under a model without
    languages. Equal code lengths go to the first language by name. Repeated rows get the same result; an empty
    table gives no rows; only ``keep`` and text are read.
    """
    kinds = {c: t for c, t in docs.dtypes}

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(keep)):
                texts = part.column(len(keep)).to_pylist()
                named, score = ["und"] * len(texts), np.zeros(len(texts))
                asked = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
                if asked:
                    bits = model.code_lengths([texts[k].encode() for k in asked])
                    best = bits.argmin(axis=1)
                    extra = bits - bits.min(axis=1, keepdims=True)
                    score[asked] = 1 / np.exp2(-np.minimum(extra, 1000)).sum(axis=1)
                    for k, b in zip(asked, best):
                        named[k] = model.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k) for k in range(len(keep))], pa.array(named, pa.string()), pa.array(score)],
                    names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", lang_pred string, score double"
    return docs.select(*keep, "text").mapInArrow(run, schema)


def learn_and_predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from all documents whose id is not in fold 2 of 4."""
    model = fit(docs.filter(fold("doc_id", 4) != 2).select("lang", "text"))
    held = (fold("doc_id", 4) == 2).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score")
