"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe the line and its neighbours; the chain adds how likely a label
follows another. Forward-backward gives each line's probability of being bad, and the probabilities, weighted by
the lines' lengths, are the share of a document that is bad; a logistic curve over it is the document's score.

Labels exist for documents only. The field starts with every line labelled as its document, is fitted, and
relabels the lines of bad documents (the worst line stays bad); this is repeated ``ROUNDS`` times. Fitting uses a
bounded sample of whole labelled documents; whole texts are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.batches import slices
from logtide.llm.samples import drawn, fold, share_of
from logtide.plans.materialize import materialize

#: About so many labelled documents are fitted on, with so many lines in all; documents of more than ``LONGEST`` lines
#: are not drawn, as a step of the fit takes a pass for each line of the longest.
SAMPLE, SAMPLE_LINES, LONGEST = 4_000, 200_000, 2_000
ROUNDS, STEPS, RATE, PENALTY = 3, 120, 0.1, 1e-3

_CLASSES = bytearray(b"." * 256)  # U upper, D digit, S sign, P punctuation, blank, else a letter
for _c in range(256):
    _t = bytes([_c])
    _CLASSES[_c] = ord("U" if _t.isupper() else "D" if _t.isdigit() else "P" if _t in b".,;:'\"-()?" else " "
                       if _t.isspace() else "S" if _c < 128 and not _t.isalnum() else ".")
_CLASSES = bytes(_CLASSES)
OWN = 10
FEATURES = 3 * OWN + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (line x ``FEATURES``) and length in characters (1 at least) of every line of a text.

    Own features first, then those of the line before and behind (zero where there is none), then first, last, one.
    """
    lines = (text or "").split("\n")
    own, lengths, seen = np.zeros((len(lines), OWN)), np.ones(len(lines)), {}
    for k, line in enumerate(lines):
        data = line.encode()
        words = data.split()
        lengths[k] = max(1, len(line))
        own[k, 0] = np.log1p(len(line)) / 10
        own[k, 8] = line in seen and len(words) > 0
        seen[line] = k
        if not words:
            own[k, 9] = 1
            continue
        kinds, n, w = data.translate(_CLASSES), len(data), len(words)
        own[k, 1] = kinds.count(b"U") / n
        own[k, 2] = kinds.count(b"S") / n
        own[k, 3] = kinds.count(b"D") / n
        own[k, 4] = kinds.count(b"P") / n
        own[k, 5] = sum(map(bytes.__eq__, words, words[1:])) / w
        own[k, 6] = 1 - len(set(words)) / w if w > 8 else 0
        own[k, 7] = min(1.0, n / w / 40)
    both = np.zeros((len(lines), FEATURES))
    both[:, :OWN] = own
    both[1:, OWN:2 * OWN] = own[:-1]
    both[:-1, 2 * OWN:3 * OWN] = own[1:]
    both[0, -3] = both[-1, -2] = both[:, -1] = 1
    return both, lengths


@dataclass
class LineField:
    """``weights``: evidence for bad per feature; ``follow[a, b]``: score of label b behind a (0 good, 1 bad);
    ``curve``: intercept and slope of the score over the bad share of a document."""

    weights: np.ndarray
    follow: np.ndarray
    curve: tuple[float, float]

    def marginals(self, emit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over documents laid end to end.

        ``emit``: evidence for bad of each line; ``sizes``: lines of each document. Returns each line's probability
        of being bad, the summed probabilities of the four transitions, and each document's log partition.
        """
        order = np.argsort(-sizes, kind="stable")  # long ones first, so that those still running are a prefix
        starts, count = (np.cumsum(sizes) - sizes)[order], sizes[order]
        score = np.stack([np.zeros_like(emit), emit], axis=1)
        ahead, behind = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
        ahead[starts] = score[starts]
        longest = int(count[0]) if len(count) else 0
        running = np.searchsorted(-count, -np.arange(longest), side="left")  # documents with more than t lines
        for t in range(1, longest):
            at = starts[:running[t]] + t
            ahead[at] = score[at] + np.logaddexp(ahead[at - 1, :1] + self.follow[0], ahead[at - 1, 1:] + self.follow[1])
        for t in range(longest - 1, 0, -1):
            at = starts[:running[t]] + t
            later = score[at] + behind[at]
            behind[at - 1] = np.logaddexp(later[:, :1] + self.follow[:, 0], later[:, 1:] + self.follow[:, 1])
        ends = np.cumsum(sizes) - 1
        total = np.logaddexp(ahead[ends, 0], ahead[ends, 1])
        of = np.repeat(total, sizes)
        bad = np.exp(ahead[:, 1] + behind[:, 1] - of)
        inner = np.ones(len(emit), bool)
        inner[np.cumsum(sizes) - sizes] = False
        second = np.flatnonzero(inner)
        pair = (ahead[second - 1][:, :, None] + self.follow + (score[second] + behind[second])[:, None, :]
                - of[second][:, None, None])
        return bad, np.exp(pair).sum(axis=0), total

    def bad_share(self, features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        bad = self.marginals(features @ self.weights, sizes)[0]
        starts = np.cumsum(sizes) - sizes
        return np.add.reduceat(bad * lengths, starts) / np.add.reduceat(lengths, starts)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of every text."""
        made = [line_features(t) for t in texts]
        sizes = np.array([len(x) for _, x in made])
        share = self.bad_share(np.concatenate([f for f, _ in made]), np.concatenate([x for _, x in made]), sizes)
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * share)))


def _fit_field(features, sizes, labels, start: LineField) -> LineField:
    """Penalised maximum likelihood of line labels, by Adam steps."""
    inner = np.ones(len(labels), bool)
    inner[np.cumsum(sizes) - sizes] = False
    second = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[second - 1], labels[second]), 1)
    value = np.concatenate([start.weights, start.follow.ravel()])
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        field = LineField(value[:-4], value[-4:].reshape(2, 2), start.curve)
        bad, pairs, _ = field.marginals(features @ field.weights, sizes)
        slope = np.concatenate([features.T @ (labels - bad), (seen - pairs).ravel()]) / len(labels) - PENALTY * value
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        value = value + RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return LineField(value[:-4], value[-4:].reshape(2, 2), start.curve)


def fit_lines(features: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> LineField:
    """Field from lines of documents laid end to end and the documents' labels (1 good, 0 bad)."""
    field = LineField(np.zeros(FEATURES), np.zeros((2, 2)), (0.0, 0.0))
    starts = np.cumsum(sizes) - sizes
    of_bad = np.repeat(good == 0, sizes)
    labels = of_bad.astype(np.int64)
    for _ in range(ROUNDS):
        field = _fit_field(features, sizes, labels, field)
        bad = field.marginals(features @ field.weights, sizes)[0]
        worst = bad == np.repeat(np.maximum.reduceat(bad, starts), sizes)
        labels = (of_bad & ((bad >= 0.5) | worst)).astype(np.int64)
    share = field.bad_share(features, lengths, sizes)
    field.curve = _fit_curve(share, good)
    return field


def _fit_curve(share: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Penalised logistic regression of the label on the bad share, by Newton steps; the slope is negative."""
    x, value = np.stack([np.ones_like(share), share], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ value))
        slope = x.T @ (good - p) - 0.1 * value
        value += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
    return float(value[0]), float(min(value[1], -1e-6))


def draw_whole(sizes: list[tuple[int, int]], lines: int) -> list[int]:
    """Keys of documents whose line counts fit into ``lines`` together, taken in the given order of (key, lines)."""
    out, held = [], 0
    for key, n in sizes:
        if held + n <= lines:
            out.append(key)
            held += n
    return out


def training_lines(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES,
                   longest: int = LONGEST) -> DataFrame:
    """(good, features, lengths) of about ``sample`` labelled documents of at most ``lines`` lines together.

    Documents are drawn whole or not at all. Labels that are null or neither 0 nor 1 are left out; where an id has
    several labels or texts, the least counts.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("good"))
    chosen = known.filter(drawn(share_of(sample, known.count()), "doc_id"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = materialize(rows.groupBy("doc_id").agg(F.min("good").alias("good"), F.min("text").alias("text")).withColumn(
        "_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).fillna(1, "_lines"))
    sizes = rows.filter(F.col("_lines") <= longest).select("doc_id", "_lines").orderBy(F.xxhash64(F.lit(9), "doc_id")).collect()
    taken = rows.sparkSession.createDataFrame([(k,) for k in draw_whole(sizes, lines)], rows.select("doc_id").schema)
    rows = rows.join(F.broadcast(taken), "doc_id").select("good", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                made = [line_features(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f.ravel().tolist() for f, _ in made], pa.list_(pa.float64())),
                     pa.array([x.tolist() for _, x in made], pa.list_(pa.float64()))],
                    names=["good", "features", "lengths"])

    return rows.mapInArrow(run, "good int, features array<double>, lengths array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """Field from labelled documents; without any, a field whose score is 1/2 for every text."""
    rows = training_lines(docs, labels, sample).toArrow()
    if not rows.num_rows:
        return LineField(np.zeros(FEATURES), np.zeros((2, 2)), (0.0, 0.0))
    order = np.lexsort([[len(x) for x in rows["lengths"].to_pylist()], [sum(x) for x in rows["features"].to_pylist()]])
    rows = rows.take(pa.array(order))  # in an order of their own, as additions depend on it
    lengths = [np.array(x) for x in rows["lengths"].to_pylist()]
    features = np.concatenate([np.array(x) for x in rows["features"].to_pylist()]).reshape(-1, FEATURES)
    good = rows["good"].to_numpy().astype(np.int64)
    return fit_lines(features, np.concatenate(lengths), np.array([len(x) for x in lengths]), good)


def score_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 likelier).

    A null or empty text is one empty line. Repeated rows get the same score; an empty table gives no rows; a
    column named score is replaced, all others stay. Only the text decides.
    """
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                score = field.score(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels outside fold 1 of 3."""
    return labels.filter(fold("doc_id", 3) != 1)


def keep_good(docs: DataFrame, field: LineField) -> DataFrame:
    """Documents with a score of at least 1/2, all columns unchanged."""
    scored = score_documents(docs.withColumn("_own_score", F.col("score")) if "score" in docs.columns else docs, field)
    kept = scored.filter("score >= 0.5")
    return kept.select(*[F.col("_own_score").alias(c) if c == "score" else F.col(f"`{c}`") for c in docs.columns])
