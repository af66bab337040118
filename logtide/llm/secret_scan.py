"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Two first-order models over the characters of identifiers are trained from labelled samples: random strings - drawn from
the usual alphabets of keys, and the secrets that the patterns find in a bounded sample of distinct texts - and ordinary
ones - names, constants, paths and file names as programs write them, put together from common parts and from words of
the sampled texts, and the strings of letters in these texts. A candidate is reported when the log-likelihood ratio of
its characters (given their predecessors) reaches the models' threshold. That is set on labelled strings held out of
training, so that at most ``FALSE_RATE`` of the ordinary ones reach it.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.batches import slices
from logtide.llm.samples import drawn, share_of
from logtide.plans.materialize import materialize

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

ALPHABET = ascii_lowercase + ascii_uppercase + digits + "+/_-"
#: Alphabets of the drawn random strings.
KEY_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", ascii_uppercase + "234567", ascii_lowercase + digits,
                 ascii_lowercase + ascii_uppercase + digits, ALPHABET)
#: Least characters of a candidate, texts to learn from, drawn strings per alphabet, made identifiers.
LEAST, SAMPLE, DRAWN, MADE = 16, 20_000, 400, 6_000
#: Fewest bits of the threshold, and the share of held-out ordinary strings that may reach it.
BITS, FALSE_RATE = 24.0, 0.001
#: Words of the sampled texts that identifiers are made from, the most frequent ones.
OWN_WORDS = 2_000

# Common parts of names in programs.
PARTS = """get set is has add remove create delete update read write load save open close start stop run init main test
    user name id key value type list map array string number index count size length max min limit retry config option
    client server request response handler manager service factory builder parser reader writer controller model view
    data file path table column row node tree graph queue cache buffer stream event message log error exception state
    status time date day hour version http json xml sql html url uri base utf encode decode hash sort filter search find
    match account address email phone order item price total local remote global default private public static final
    src lib bin test java org com net apache spark python node modules build dist docs kubectl pods all deploy access
    window frame button color width height left right top bottom first last next previous current
    axis box fix hex mix pixel proxy regex suffix prefix vertex matrix export express fuzzy lazy quiz zero zone zoom zip gzip
    jazz jump job join major object project subject quick quit quota quote equal require sequence unique frequency
    sync async system type style symbol yield year yes array delay display layer layout retry verify copy empty
    web wrap write view wave swap switch hook lookup rollback track block lock unlock click check flush push hash cache
    vote vivid wake walk weak week wolf wood world worker whisper whale rhythm crypt glyph lynx myth nymph physics psych
    alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra
    uniform victor xray foo bar baz qux""".split()
SUFFIXES = ("", "", "", "1", "2", "V2", "_v2", "64", "utf8", "_str", "Impl", ".py", ".java", ".js", ".txt", ".html", ".json")

_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
_N = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in characters, by start and then kind."""
    low, found = text.lower(), []
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    for start, end in _runs(text, 16):  # a hex string lies in a run of identifier characters
        if end - start >= 32:
            found += [(start + m.start(), start + m.end(), "hex") for m in _HEX.finditer(text[start:end])
                      if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _runs(text: str, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` characters of the alphabet, in characters."""
    data = text.encode()
    other = np.flatnonzero(_CODE[np.frombuffer(data, np.uint8)] == 0)
    edges = np.concatenate([[-1], other, [len(data)]])
    long = np.flatnonzero(np.diff(edges) > least)
    starts, ends = edges[long] + 1, edges[long + 1]
    if len(starts) and len(data) != len(text):  # bytes to characters
        lead = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
        shift = starts - np.where(starts > 0, lead[starts - 1], 0)
        starts, ends = starts - shift, ends - shift
    return list(zip(starts.tolist(), ends.tolist()))


def _outside(runs, spans):
    """Runs that touch none of the spans, which are sorted by start."""
    starts = [s for s, _, _ in spans]
    reach = list(accumulate((e for _, e, _ in spans), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)  # spans that begin ahead of the run's end
        return before == 0 or reach[before - 1] <= start

    return [r for r in runs if free(*r)]


@dataclass
class CharacterModels:
    """``ratio[a, b]``: bits for random against ordinary when b follows a (0 stands for the start); ``threshold``: bits
    from which on a string counts as random."""

    ratio: np.ndarray
    threshold: float = BITS

    @classmethod
    def from_counts(cls, rare: np.ndarray, plain: np.ndarray, threshold: float = BITS) -> CharacterModels:
        def logs(counts):  # smoothed by the model's own frequencies, these by one of each character
            single = counts.sum(axis=0)[1:] + 1.0
            single /= single.sum()
            return np.log2((counts[:, 1:] + 8.0 * single) / (counts[:, 1:].sum(axis=1, keepdims=True) + 8.0))

        ratio = np.zeros((_N, _N))
        ratio[:, 1:] = logs(rare) - logs(plain)
        return cls(ratio, threshold)

    def bits(self, token: str) -> float:
        codes = _CODE[np.frombuffer(token.encode(), np.uint8)]
        return float(self.ratio[np.concatenate([[0], codes[:-1]]), codes].sum())


def _count(tokens: list[str]) -> np.ndarray:
    counts = np.zeros((_N, _N), np.int64)
    if tokens:
        codes = _CODE[np.frombuffer(" ".join(["", *tokens]).encode(), np.uint8)]
        pairs = codes[:-1] * _N + codes[1:]
        counts += np.bincount(pairs, minlength=_N * _N).reshape(_N, _N)
        counts[:, 0] = 0  # ends of tokens
    return counts


def drawn_strings(per_alphabet: int = DRAWN, seed: int = 3) -> list[str]:
    """Random strings over the alphabets of keys."""
    rng = random.Random(seed)
    return ["".join(rng.choices(a, k=rng.randint(LEAST, 60))) for a in KEY_ALPHABETS for _ in range(per_alphabet)]


def made_identifiers(words: list[str], count: int = MADE, seed: int = 4) -> list[str]:
    """Ordinary strings: names in the usual styles, constants, paths and file names, compounds of own words."""
    rng, out = random.Random(seed), []
    for k in range(count):
        source = words if words and k % 3 == 0 else PARTS
        parts = [rng.choice(source) for _ in range(rng.randint(2, 6))]
        style = rng.choice(["camel", "pascal", "_", "_", "-", "/", "/", "constant", "compound"])
        if style in ("camel", "pascal"):
            name = "".join(p[:1].upper() + p[1:] for p in parts)
            name = name if style == "pascal" else name[:1].lower() + name[1:]
        elif style == "constant":
            name = "_".join(parts).upper()
        elif style == "compound":
            name = "".join(parts).capitalize()
        else:
            name = style.join(parts)
        if rng.random() < 0.2:  # dates, times and numbers
            day = (rng.randint(1980, 2039), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))
            form = rng.choice(("-%04d-%02d-%02d", "_%04d%02d%02d", "-%04d-%02d-%02dT%02d%02d", "/%04d/%02d/%02d", "%04d"))
            name += form % day[:form.count("%")]
        out.append(re.sub(r"[^A-Za-z0-9+/_-]", "-", name + rng.choice(SUFFIXES)))
    return out


def _sampled(docs: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` distinct texts, stored. Copies count as one text and do not displace others."""
    hashed = docs.filter("text is not null").select("text", F.xxhash64("text").alias("_hash"))
    share = share_of(sample, hashed.select("_hash").distinct().count())
    return materialize(hashed.filter(drawn(share, "_hash")).dropDuplicates(["_hash"]).select("text"))


def count_pairs(texts: DataFrame) -> DataFrame:
    """(secret, pair, n): character pairs within secrets of the patterns, and within the strings of ASCII letters."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                plain, rare = [], []
                for text in part.column(0).to_pylist():
                    spans = base_spans(text)
                    plain += filter(str.isalpha, (text[a:b] for a, b in _outside(_runs(text, 4), spans)))
                    for a, b, kind in spans:
                        value = _ASSIGN.match(text[a:b])[2] if kind == "assign" else text[a:b]
                        rare += [value[c:d] for c, d in _runs(value, 8)]
                for secret, tokens in ((False, plain), (True, rare)):
                    counts = _count(tokens).ravel()
                    seen = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([secret] * len(seen), pa.bool_()), pa.array(seen), pa.array(counts[seen])],
                        names=["secret", "pair", "n"])

    counted = texts.select("text").mapInArrow(run, "secret boolean, pair long, n long")
    return counted.groupBy("secret", "pair").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, most: int = OWN_WORDS) -> list[str]:
    """Words of 2 to 12 lower-case ASCII letters by falling frequency in the sampled texts."""
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit("(?<![^ ])[a-z]{2,12}(?![^ ])"), F.lit(0))).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def fit(docs: DataFrame, sample: int = SAMPLE) -> CharacterModels:
    """Models and threshold from labelled strings and about ``sample`` distinct texts.

    The counts that come to the driver are at most two squares of the alphabet, and ``OWN_WORDS`` words. Counts of
    the texts and of the made strings weigh alike in either model, so that neither drowns the other. Every fourth
    made and drawn string is held out.
    """
    texts = _sampled(docs, sample)
    counts = {True: np.zeros((_N, _N)), False: np.zeros((_N, _N))}
    for r in count_pairs(texts).collect():
        counts[r["secret"]][divmod(r["pair"], _N)] += r["n"]
    made = {True: drawn_strings(), False: made_identifiers(frequent_words(texts))}
    for secret, strings in made.items():
        own = _count([t for k, t in enumerate(strings) if k % 4])
        total = counts[secret].sum()
        counts[secret] = own + counts[secret] * (min(1.0, own.sum() / total) if total else 0.0)
    models = CharacterModels.from_counts(counts[True], counts[False])
    held = sorted(models.bits(t) for t in made[False][::4] if len(t) >= LEAST)
    models.threshold = max(BITS, held[-1 - int(FALSE_RATE * len(held))] + 1e-6)
    return models


def rates(models: CharacterModels, random_strings: list[str], ordinary: list[str]) -> tuple[float, float]:
    """Shares of random and of ordinary strings, as found by their length, that reach the threshold."""
    def share(strings):
        asked = [t for t in strings if len(t) >= LEAST]
        return sum(looks_random(t, models) for t in asked) / max(1, len(asked))

    return share(random_strings), share(ordinary)


def looks_random(token: str, models: CharacterModels, bits: float | None = None) -> bool:
    """True for a string with a letter and with a digit or sign whose bits reach the threshold."""
    mixed = any(map(str.isalpha, token)) and not token.isalpha()
    return mixed and models.bits(token) >= (models.threshold if bits is None else bits)


def scan(text: str, models: CharacterModels, bits: float | None = None) -> list[tuple[int, int, str]]:
    """All spans: those of the patterns, and random strings apart from them."""
    spans = base_spans(text)
    for start, end in _outside(_runs(text, LEAST), spans):
        if looks_random(text[start:end], models, bits):
            stop = min(len(text), end + 2)
            while end < stop and text[end] == "=":
                end += 1
            spans.append((start, end, "random"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, models: CharacterModels, bits: float | None = None) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end), characters, end exclusive, by start and then kind.

    Kinds are assign, access, hex (fixed patterns) and random (the models; ``bits`` takes the place of their threshold). A null text counts as empty; repeated
    rows get the same result; an empty table gives no rows; a column named secrets is replaced, all others stay.
    """
    docs = docs.drop("secrets")
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                found = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(t or "", models, bits)]
                         for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)],
                                                 names=[*part.schema.names, "secrets"])

    span = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("secrets", T.ArrayType(span))]))


def written(secrets: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number(secrets: str, kind: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")
