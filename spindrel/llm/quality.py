"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the unlabelled set is web text
taken without looking at labels, good and bad mixed in an unknown proportion.  With the
class prior p, loss l and score g, the risk

    p * E+[l(g)] + max(0, E_u[l(-g)] - p * E+[l(-g)])

needs no negatives; the second term is what negatives would contribute, and keeping it
from falling below zero stops a flexible model from overfitting it.

The prior is estimated from positives and unlabelled text alone (best bin): a model first
learns to tell the two apart; above a threshold t on its score the unlabelled share, u(t),
holds the positives' share, g(t), p times at least, so p is at most u(t) / g(t), and the
threshold of the smallest such bound, with its sampling error, gives the estimate.

The model is a small network over features of the whole text: shares of character
classes, of runs and of repetition.  At most ``SAMPLE`` trusted positives are used, those of
the smallest keyed digest.  The unlabelled expectation runs over all documents: each counts
for the nearest of ``PROTOTYPES`` documents drawn by keyed digest, so that what is fitted
has a bounded number of weighted points and every document has its weight in it.

Defined results: a null text counts as empty and is scored as such; without positives or
without any document to learn from every score is 0.5; repeated rows are scored each, and
weigh in the unlabelled set each; a document with several labels is a positive if one of
them is 1; of a repeated id that is drawn one row stands for all; a text of more than
``PIECE_BYTES`` is read whole, a piece between words at a time; other columns are ignored;
no rows give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrel.llm.common import id_remainder, table

SAMPLE = 4_000
PROTOTYPES = 4_000
HELD_OUT = (3, 1)
HIDDEN = 16
STEPS = 400
RATE = 0.02
DECAY = 1e-4
SEED = 11
SLICE_BYTES = 1 << 21
PIECE_BYTES = 1 << 22

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _OTHER, _HIGH = range(9)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[128:] = _HIGH
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[0x0A] = _LINE
_CLASS[ord(".")] = _STOP
_CLASS[ord(",")] = _COMMA

FEATURES = 24
#: Places of the sums of a text: bytes by class come first.
_N, _SAME, _ODDS, _STARTS, _CAPITALS, _ODD_STARTS, _ODD_ENDS, _LONE_ODDS, _LETTERS, _LENGTHS, _SQUARES, _AGAIN = range(9, 21)
SUMS = 21


def tallies(data: np.ndarray, bounds: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
    """Sums over each text (UTF-8 laid end to end), texts by SUMS.

    ``counted`` is where counting starts in each text, at the start of a word; what comes
    before is context only.
    """
    texts = len(bounds) - 1
    begin = bounds[:-1] if counted is None else counted
    kind = _CLASS[data]

    def sums(x: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
        return run[bounds[1:]] - run[begin]

    inner = np.ones(len(data), bool)
    inner[bounds[:-1][bounds[:-1] < len(data)]] = False  # the first byte of a text has none before it
    before = np.concatenate((kind[:1], kind[:-1]))
    same_byte = inner & (data == np.concatenate((data[:1], data[:-1])))
    blank = (kind == _SPACE) | (kind == _LINE)
    starts = ~blank & (~inner | (before == _SPACE) | (before == _LINE))
    after = np.concatenate((blank[1:] | ~inner[1:], [True])) if len(data) else blank
    odd = kind == _OTHER
    lone = starts & after
    start_at, ends = np.flatnonzero(starts), np.flatnonzero(~blank & after)
    owner = np.searchsorted(bounds, start_at, side="right") - 1
    own = start_at >= begin[owner] if len(owner) else np.zeros(0, bool)
    length = (ends - start_at + 1).astype(np.float64)
    # a word like the one before it: same length, byte sum and sum of squares
    value = data.astype(np.int64)
    again = np.zeros(len(start_at), bool)
    prints = np.stack([length] + [np.diff(np.concatenate(([0], np.cumsum(v)))[np.stack((start_at, ends + 1), 1)], axis=1)[:, 0] for v in (value, value**2)])
    again[1:] = (prints[:, 1:] == prints[:, :-1]).all(0) & (owner[1:] == owner[:-1])
    out = np.zeros((texts, SUMS))
    for k in range(9):
        out[:, k] = sums(kind == k)
    for k, x in (
        (_N, np.ones(len(data), bool)), (_SAME, same_byte), (_ODDS, odd & inner & (before == _OTHER)), (_STARTS, starts), (_CAPITALS, starts & (kind == _UPPER)),
        (_ODD_STARTS, starts & odd), (_ODD_ENDS, odd & after), (_LONE_ODDS, lone & odd), (_LETTERS, (kind == _LOWER) | (kind == _UPPER) | (kind == _HIGH)),
    ):
        out[:, k] = sums(x)
    for k, x in ((_LENGTHS, length), (_SQUARES, length**2), (_AGAIN, again)):
        out[:, k] = np.bincount(owner[own], x[own], texts)
    return out


def _finished(sums: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Features from the sums of each text and the share of its lines that stand there before."""
    n, words = np.maximum(sums[:, _N], 1), np.maximum(sums[:, _STARTS], 1)
    mean = sums[:, _LENGTHS] / words
    out = np.zeros((len(sums), FEATURES))
    out[:, :9] = sums[:, :9] / n[:, None]
    out[:, _DIGIT] = sums[:, _AGAIN] / words  # digits themselves say little
    out[:, 9] = sums[:, _SAME] / n
    out[:, 10] = sums[:, _ODDS] / n
    out[:, 11] = sums[:, _CAPITALS] / words
    out[:, 12] = sums[:, _ODD_STARTS] / words
    out[:, 13] = sums[:, _ODD_ENDS] / words
    out[:, 14] = sums[:, _LONE_ODDS] / words
    out[:, 15] = sums[:, _UPPER] / np.maximum(sums[:, _UPPER] + sums[:, _LOWER], 1)
    out[:, 16] = mean
    out[:, 17] = np.sqrt(np.maximum(sums[:, _SQUARES] / words - mean**2, 0))
    out[:, 18] = sums[:, _STOP] / words
    out[:, 19] = sums[:, _COMMA] / words
    out[:, 20] = sums[:, _LINE] / words
    out[:, 21] = np.log1p(words)
    out[:, 22] = sums[:, _LETTERS] / n
    out[:, 23] = repeated
    return out


def _repeated_lines(text: bytes) -> float:
    """The share of lines that are not the first of their kind."""
    if len(text) <= PIECE_BYTES:
        lines = text.split(b"\n")
        return 1 - len(set(lines)) / len(lines)
    seen, count, at = set(), 0, 0
    while at >= 0:
        to = text.find(b"\n", at)
        seen.add(xxhash.xxh3_128_digest(text[at : to if to >= 0 else len(text)]))
        count, at = count + 1, to + 1 if to >= 0 else -1
    return 1 - len(seen) / count


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start of the word before, start, end) of pieces of a long text that end between words."""
    blank = lambda a, b: np.flatnonzero(np.isin(_CLASS[data[a:b]], (_SPACE, _LINE)))
    context = at = 0
    while at < len(data):
        to = min(len(data), at + PIECE_BYTES)
        while to < len(data):  # on to the start of a word
            held = blank(to - 1, to)
            if len(held) and not len(blank(to, to + 1)):
                break
            to += 1
        yield context, at, to
        piece = _CLASS[data[at:to]]
        white = (piece == _SPACE) | (piece == _LINE)
        first = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
        context, at = at + int(first[-1]) if len(first) else at, to


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts (UTF-8 laid end to end) by FEATURES."""
    if len(bounds) == 2 and len(data) > PIECE_BYTES:
        sums = sum(tallies(data[c:b], np.array([0, b - c]), np.array([a - c])) for c, a, b in _pieces(data))
    else:
        sums = tallies(data, bounds)
    repeated = [_repeated_lines(data[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return _finished(sums, np.array(repeated))


def _laid(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of about SLICE_BYTES: from, to, bytes, bounds."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Network:
    """One hidden layer over standardised features, fitted by Adam on a slope per score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        random = np.random.default_rng(SEED)
        self.parts = [random.normal(0, 0.5, (FEATURES, HIDDEN)) / np.sqrt(FEATURES), np.zeros(HIDDEN), random.normal(0, 0.5, HIDDEN), np.array(0.0)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.parts
        hidden = np.tanh(z @ w1 + b1)
        return hidden, hidden @ w2 + b2

    def gradients(self, z: np.ndarray, hidden: np.ndarray, by_score: np.ndarray) -> list[np.ndarray]:
        back = np.outer(by_score, self.parts[2]) * (1 - hidden**2)
        return [z.T @ back, back.sum(0), hidden.T @ by_score, np.array(by_score.sum())]

    def fit(self, z: np.ndarray, slopes: Callable[[np.ndarray], np.ndarray]) -> None:
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        for step in range(1, STEPS + 1):
            hidden, scores = self.forward(z)
            for i, g in enumerate(self.gradients(z, hidden, slopes(scores))):
                g = g + DECAY * self.parts[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.parts[i] = self.parts[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(self.standard(x))[1])


def risk(scores: np.ndarray, positives: int, weights: np.ndarray, prior: float) -> tuple[float, float]:
    """(positive part, negative part before it is kept from falling below 0), with the sigmoid loss."""
    s = _sigmoid(scores)
    good, rest = s[:positives], s[positives:]
    return prior * float(1 - good.mean()), float(weights @ rest - prior * good.mean())


def risk_slopes(scores: np.ndarray, positives: int, weights: np.ndarray, prior: float) -> np.ndarray:
    """Derivatives of the kept risk by each score; below 0 it climbs back on the negative part alone."""
    s = _sigmoid(scores)
    slope = s * (1 - s)
    slope[:positives] /= positives
    slope[positives:] *= weights
    _, negative = risk(scores, positives, weights, prior)
    by_p, by_u = (-2 * prior, 1.0) if negative >= 0 else (prior, -1.0)
    return np.concatenate((by_p * slope[:positives], by_u * slope[positives:]))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, weights: np.ndarray, effective: float) -> float:
    """The smallest bound u(t) / g(t) on the prior over thresholds t, by its upper confidence limit."""
    t = np.unique(positive)
    g = 1 - np.searchsorted(np.sort(positive), t, side="left") / len(positive)
    order = np.argsort(unlabelled)
    above = np.concatenate((np.cumsum(weights[order][::-1])[::-1], [0.0]))
    u = above[np.searchsorted(unlabelled[order], t, side="left")]
    error = np.sqrt(np.log(40) / 2 / effective) + np.sqrt(np.log(40) / 2 / len(positive))
    at = int(np.argmin((u + error) / g))
    return float(np.clip(u[at] / g[at], 0.01, 0.99))


class Model:
    """What ``learn`` fits: scores by features; 0.5 for all where there is nothing to learn from."""

    def __init__(self, positive: np.ndarray | None = None, unlabelled: np.ndarray | None = None, weights: np.ndarray | None = None, prior: float | None = None):
        self.prior, self.network = 0.5 if prior is None else prior, None
        if positive is None or not len(positive) or not len(unlabelled):
            return
        total = weights.sum()
        weights = weights / total
        mean = weights @ unlabelled
        scale = np.sqrt(weights @ (unlabelled - mean) ** 2) + 1e-6
        p = len(positive)
        both = np.concatenate((positive, unlabelled))
        if prior is None:  # fitted on every other point, and read off the rest
            apart = Network(mean, scale)
            half, mine = len(positive[::2]), weights[::2] / weights[::2].sum()
            apart.fit(
                apart.standard(np.concatenate((positive[::2], unlabelled[::2]))),
                lambda g: np.concatenate(((_sigmoid(g[:half]) - 1) / half, _sigmoid(g[half:]) * mine)),
            )
            others = (positive[1::2], unlabelled[1::2], weights[1::2]) if min(p, len(unlabelled)) > 1 else (positive, unlabelled, weights)
            self.prior = best_bin(apart(others[0]), apart(others[1]), others[2] / others[2].sum(), float(len(others[1])))
        self.network = Network(mean, scale)
        z = self.network.standard(both)
        self.network.fit(z, lambda g: risk_slopes(g, p, weights, self.prior))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.network is None else self.network(x)


def _drawn(docs: DataFrame, ids: list) -> np.ndarray:
    """Features of the documents of a bounded list of ids, one row of each, in the order of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in _laid(batch.column(2)):
                x = features(data, bounds)
                part = batch.slice(at, to - at)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "print", "x"])

    rows = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.xxhash64("text").alias("print"), "text")
    found = rows.mapInArrow(run, "doc_id long, print long, x array<double>").groupBy("doc_id").agg(F.min(F.struct("print", "x"))["x"].alias("x"))
    by_id = {r["doc_id"]: r["x"] for r in found.collect()}
    return np.array([by_id[i] for i in ids if i in by_id]).reshape(-1, FEATURES)


def _weights(docs: DataFrame, prototypes: np.ndarray) -> np.ndarray:
    """How many of all documents lie nearest to each prototype, by standardised features."""
    mean, scale = prototypes.mean(0), prototypes.std(0) + 1e-6
    standard = lambda x: np.clip((x - mean) / scale, -6, 6).astype(np.float32)
    points = standard(prototypes)
    half = (points * points).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(points), np.int64)
        for batch in batches:
            for _, _, data, bounds in _laid(batch.column(0)):
                z = standard(features(data, bounds))
                for a in range(0, len(z), 256):
                    counts += np.bincount((half - z[a : a + 256] @ points.T).argmin(1), minlength=len(points))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["at", "n"])

    out = np.zeros(len(points))
    for r in docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, prototypes: int = PROTOTYPES, prior: float | None = None) -> Model:
    """Fit on documents and labels (doc_id, quality); pass only rows that may be learned from."""
    key = lambda c: F.xxhash64(F.lit("quality"), F.col(c))
    ids = lambda df, n: [r[0] for r in df.where("doc_id is not null").select("doc_id").distinct().orderBy(key("doc_id"), "doc_id").limit(n).collect()]
    text = docs.select(F.col("doc_id").cast("long"), "text")
    trusted = ids(labels.where("quality = 1"), sample)
    points = _drawn(text, ids(text, prototypes)) if trusted else None
    if points is None or not len(points):
        return Model()
    return Model(_drawn(text, trusted), points, _weights(text, points), prior)


def score(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in _laid(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(model.score(features(data, bounds)))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    modulus, held = HELD_OUT
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    free = id_remainder("doc_id", modulus) != held
    model = learn(docs.where(free), labels.where(free))
    return score(docs, model).select(
        "doc_id", (id_remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
