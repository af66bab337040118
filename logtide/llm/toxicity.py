"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of lexicon words, how close they stand to words of the second person, capitals,
punctuation and signs of obfuscation (``FEATURES``). The lexicon is learnt from the labelled texts: whole words and
beginnings of words of 3 to 7 letters, each with the log-odds of the label among the texts that hold it, so that
words never seen in a label's texts still count by how they begin.

Fitting takes a bounded sample of distinct labelled texts. They are dealt into folds by their hash; a text's lexicon
features leave out the counts of its own fold, and the calibration curve is drawn through predictions of trees that
were grown without the text's fold, so neither sees the label that it predicts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.batches import slices
from logtide.llm.samples import drawn, fold, share_of
from logtide.plans.materialize import materialize

#: About so many distinct labelled texts are fitted on.
SAMPLE = 20_000
FOLDS = 4
#: Texts of the label that a lexicon entry must be in, and the log-odds from which on it counts as weak, fair, strong.
LEAST_TEXTS, TIERS = 3, (2.0, 3.0, 4.5)
#: Words between a lexicon word and one of the second person that count as close.
NEAR = 5
#: Tokens whose rows a task keeps.
KEPT = 200_000
TREES, DEPTH, RATE, BINS, PENALTY, LEAST_WEIGHT = 150, 3, 0.1, 64, 1.0, 1.0

# Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("""you your yours yourself yourselves u ur ya du dich dir dein deine deinen deinem deiner
    ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes vosotros vuestro""".split())
# Signs that stand for letters.
_LEET = str.maketrans("@4301!|57$8", "aaeoiiistsb")

FEATURES = [
    "log_words", "weak", "fair", "strong", "strong_count", "different", "evidence", "strongest", "second_person",
    "close_share", "closeness", "capitals", "shouted", "exclamations", "questions", "punctuation", "digits", "hidden",
    "hidden_hits", "stretched", "repeated",
]
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LETTERS = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_]\d+[^\W\d_]|[^\W\d_]_+[^\W\d_]")
_STRETCHED = re.compile(r"([a-z])\1\1")
# columns of a word's own row
_STRENGTH, _SECOND, _HIDDEN, _HIDDEN_HIT, _STRETCH = range(5)


def stems(word: str) -> list[str]:
    """Lexicon entries that a lower-case word of letters may match: itself, and its beginnings marked by ``~``."""
    return [word, *(word[:k] + "~" for k in range(3, min(7, len(word) - 1) + 1))]


def plain_forms(token: str) -> tuple[list[str], bool]:
    """The words of letters in a lower-case token; where signs stand inside or for letters, what they hide, and True."""
    found = _LETTERS.findall(token)
    if not _INNER.search(token):
        return found, False
    hidden = re.sub(r"[\W\d_]+", "", token.strip(".,;:?\"'()[]").translate(_LEET))
    return [*found, hidden], hidden not in found and hidden != ""


@dataclass
class Lexicon:
    """Entry -> log-odds."""

    strength: dict[str, float]

    def __post_init__(self):
        self.starts = {e.rstrip("~")[:3] for e in self.strength} | {w[:3] for w in SECOND_PERSON}
        self.described: tuple[dict[str, list[float]], ...] = {}, {}

    def of(self, word: str) -> float:
        if word[:3] not in self.starts:
            return 0.0
        return max(self.strength.get(s, 0.0) for s in stems(word))

    def describe(self, token: str) -> list[float]:
        """Strength, second person, hidden, hidden and in the lexicon, stretched."""
        forms, hides = ([token], False) if token.isalpha() else plain_forms(token)
        each = [self.of(w) for w in forms]
        best = max(each, default=0.0)
        return [best, any(w in SECOND_PERSON for w in forms), hides, hides and best > 0 and each[-1] == best,
                _STRETCHED.search(token) is not None]

    def mark(self, tokens: list[str], stretched: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the tokens that have any of the signs, the number of each one's word, and the words' rows."""
        starts = self.starts
        asked = [t for t in set(tokens) if t[:3] in starts or not t.isalpha()]
        if stretched:
            asked = list({*asked, *filter(_STRETCHED.search, set(tokens))})
        known: dict[str, int] = {}
        rows = []
        described = self.described[stretched]
        if len(described) > KEPT:
            described.clear()
        for t in asked:
            row = described.get(t)
            if row is None:
                bare = t.strip(".,;:!?")
                if bare.isalpha() and not stretched and bare[:3] not in starts:
                    row = []  # none of the signs
                else:
                    row = self.describe(bare if bare.isalpha() else t)
                    row = row if any(row) else []
                if len(t) < 64:
                    described[t] = row
            if row:
                known[t] = len(rows)
                rows.append(row)
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 5))
        found = [(k, known[t]) for k, t in enumerate(tokens) if t in known]
        at, code = np.array(found).T
        return at, code, np.array(rows, float)


def _stretches(data: bytes) -> bool:
    """True where three equal ASCII letters may stand side by side."""
    own = np.frombuffer(data, np.uint8) | 32
    return bool(((own[2:] == own[1:-1]) & (own[2:] == own[:-2]) & (own[2:] >= 97) & (own[2:] <= 122)).any())


def text_features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """The ``FEATURES`` of a text; all zero without words."""
    out = np.zeros(len(FEATURES))
    low = (text or "").lower()
    tokens = low.split()
    if not tokens:
        return out
    data, n = text.encode(), len(tokens)
    marked, codes, rows = lexicon.mark(tokens, _stretches(data))
    each = rows[codes]
    strength, second = each[:, _STRENGTH], marked[each[:, _SECOND] > 0]
    hits = marked[strength >= TIERS[1]]
    out[0] = np.log1p(n)
    out[1:4] = [(strength >= t).sum() / n for t in TIERS]
    out[4] = np.log1p((strength >= TIERS[2]).sum())
    different = rows[:, _STRENGTH]
    out[5] = np.log1p((different >= TIERS[1]).sum())
    out[6] = np.log1p(different[different >= TIERS[0]].sum())
    out[7] = strength.max(initial=0)
    out[8] = len(second) / n
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[at.clip(max=len(second) - 1)] - hits), np.abs(second[(at - 1).clip(0)] - hits))
        out[9] = (gap <= NEAR).mean()
        out[10] = 1 / (1 + gap.min())
    size = len(data)
    out[11] = (size - len(data.translate(None, _UPPER))) / size
    out[12] = sum(map(str.isupper, text.split())) / n
    out[13] = data.count(b"!") / n
    out[14] = data.count(b"?") / n
    out[15] = (size - len(data.translate(None, _MARKS))) / size
    out[16] = (size - len(data.translate(None, _DIGITS))) / size
    out[17:20] = each[:, [_HIDDEN, _HIDDEN_HIT, _STRETCH]].sum(axis=0) / n
    out[20] = sum(map(str.__eq__, tokens, tokens[1:])) / n
    return out


@dataclass
class BoostedTrees:
    """Complete binary trees: inner node k has children 2k + 1 (feature <= cut) and 2k + 2; leaves hold values."""

    start: float
    features: np.ndarray  # tree x inner node
    cuts: np.ndarray
    leaves: np.ndarray    # tree x leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return total


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> BoostedTrees:
    """Newton boosting of the logistic loss; splits lie at quantiles of the features."""
    inner = 2 ** DEPTH - 1
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    raw = np.full(len(x), start)
    model = BoostedTrees(start, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf),
                         np.zeros((trees, inner + 1)))
    width, kinds = BINS + 1, x.shape[1]
    cuts = np.full((kinds, width), np.inf)
    for f, e in enumerate(edges):
        cuts[f, :len(e)] = e
    flat = bins + width * np.arange(kinds)
    rows = np.arange(len(x))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-9)
        slopes, curves = (np.repeat(v, kinds) for v in (slope, curve))
        node = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            first, count = 2 ** depth - 1, 2 ** depth
            local = node - first
            key = (flat + (local * kinds * width)[:, None]).ravel()
            g, h = (np.bincount(key, v, count * kinds * width).reshape(count, kinds, width) for v in (slopes, curves))
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl ** 2 / (hl + PENALTY) + gr ** 2 / (hr + PENALTY) - gt ** 2 / (ht + PENALTY)
            gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT) | np.isinf(cuts)] = 0
            gain = gain.reshape(count, -1)
            at = gain.argmax(1)
            better = gain[np.arange(count), at] > 1e-9
            model.features[t, first:first + count][better] = at[better] // width
            model.cuts[t, first:first + count][better] = cuts.ravel()[at[better]]
            cut_bin = np.where(better, at % width, width)
            node = 2 * node + 1 + (bins[rows, model.features[t, node]] > cut_bin[local])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        model.leaves[t] = RATE * g / (h + PENALTY)
        raw = raw + model.leaves[t][leaf]
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing curve of least squares through (raw, y) by pooling: knots and their values."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of raw
    for r, v in zip(raw[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, r])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, r2 = blocks.pop()
            v1, w1, r1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, r1 + r2]
    return np.array([r / w for _, w, r in blocks]), np.array([v for v, _, _ in blocks])


@dataclass
class Model:
    """``trees`` is None where the labels do not differ; every text then scores ``share``."""

    lexicon: Lexicon
    trees: BoostedTrees | None
    knots: np.ndarray
    values: np.ndarray
    share: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        raw = self.trees.raw(np.stack([text_features(t, self.lexicon) for t in texts]))
        # a thousandth of the plain curve keeps the order of texts on one step
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 / (1 + np.exp(-raw))


def strengths(counts: dict[str, tuple[float, float]], toxic: float, clean: float) -> dict[str, float]:
    """Entry -> log-odds of those in enough toxic texts and strong enough; ``counts``: texts of either kind."""
    out = {}
    for s, (p, n) in counts.items():
        if p >= LEAST_TEXTS and (odds := np.log((p + 0.5) / (toxic + 1) * (clean + 1) / (n + 0.5))) >= TIERS[0]:
            out[s] = float(odds)
    return out


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, fold, text): about ``sample`` distinct labelled texts, stored.

    Labels other than 0 and 1 are left out; of several labels of an id, and of a text, the greatest counts. Copies
    count as one text.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("label"))
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    texts = hashed.join(known, "doc_id").groupBy("_hash").agg(
        F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))
    chosen = texts.filter(drawn(share_of(sample, texts.count()), "_hash"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    rows = rows.join(F.broadcast(chosen), ["doc_id", "_hash"]).dropDuplicates(["_hash"])
    return materialize(rows.select("label", F.pmod(F.xxhash64(F.lit(3), "_hash"), F.lit(FOLDS)).cast("int").alias("fold"),
                                   "text"))


def count_stems(texts: DataFrame) -> DataFrame:
    """(stem, fold, toxic, clean): texts of a fold that hold an entry, for those in enough toxic texts."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                counts: dict[tuple[str, int], list[int]] = {}
                for label, own, text in zip(*(c.to_pylist() for c in part.columns)):
                    words = {w for t in set(text.lower().split()) for w in plain_forms(t)[0]}
                    for s in {s for w in words for s in stems(w)}:
                        counts.setdefault((s, own), [0, 0])[1 - label] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()),
                     pa.array([v[0] for v in counts.values()], pa.int64()),
                     pa.array([v[1] for v in counts.values()], pa.int64())], names=["stem", "fold", "toxic", "clean"])

    found = texts.select("label", "fold", "text").mapInArrow(run, "stem string, fold int, toxic long, clean long")
    each = found.groupBy("stem", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    by_stem = each.groupBy("stem").agg(F.sum("toxic").alias("_all"), F.collect_list(
        F.struct("fold", "toxic", "clean")).alias("folds")).filter(F.col("_all") >= LEAST_TEXTS)  # FOLDS rows a stem
    return by_stem.select("stem", F.explode("folds").alias("f")).select("stem", "f.*")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from the labelled documents. What comes to the driver is bounded by ``sample``."""
    texts = training_texts(docs, labels, sample)
    sums = np.zeros((FOLDS, 2))
    for r in texts.groupBy("fold", "label").count().collect():
        sums[r["fold"], 1 - r["label"]] = r["count"]
    toxic, clean = sums.sum(axis=0)
    if not toxic or not clean:
        return Model(Lexicon({}), None, np.empty(0), np.empty(0), toxic / max(1, toxic + clean))
    counts = count_stems(texts).toArrow()
    whole: dict[str, tuple[int, int]] = {}
    part: list[dict[str, tuple[int, int]]] = [{} for _ in range(FOLDS)]
    for s, own, p, n in zip(*(c.to_pylist() for c in counts.columns)):
        part[own][s] = (p, n)
        before = whole.get(s, (0, 0))
        whole[s] = (before[0] + p, before[1] + n)
    lexicons = []
    for k in range(FOLDS):
        left = {s: (p - part[k].get(s, (0, 0))[0], n - part[k].get(s, (0, 0))[1]) for s, (p, n) in whole.items()}
        lexicons.append(Lexicon(strengths(left, *(sums.sum(axis=0) - sums[k]))))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                made = [text_features(t, lexicons[k]).tolist() for k, t in
                        zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.list_(pa.float64()))],
                                                 names=["label", "fold", "x"])

    rows = texts.select("label", "fold", "text").mapInArrow(run, "label int, fold int, x array<double>").toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, len(FEATURES))
    y, own = rows["label"].to_numpy().astype(float), rows["fold"].to_numpy()
    order = np.lexsort([*x.T, y, own])  # in an order of their own, as additions depend on it
    x, y, own = x[order], y[order], own[order]
    apart = np.zeros(len(y))
    for k in np.unique(own):
        others = own != k
        if others.any():
            apart[own == k] = grow(x[others], y[others]).raw(x[own == k])
    knots, values = isotonic(apart, y)
    return Model(Lexicon(strengths(whole, toxic, clean)), grow(x, y), knots, values)


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score (0 to 1, higher: label 1 likelier).

    A null text is scored as an empty one, which has features of its own (all zero). Repeated rows get the same
    score; an empty table gives no rows; only ``keep`` and text are read, so no other column can clash. Where the
    labels hold one kind only, every text scores its share (0 without any label).
    """
    def run(batches):
        at = len(keep)
        for batch in batches:
            for part in slices(batch, at):
                score = model.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(score, pa.float64())],
                                                 names=[*keep, "score"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels outside fold 2 of 4."""
    return labels.filter(fold("doc_id", 4) != 2)
