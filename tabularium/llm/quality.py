"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are simple shares of its bytes and words, the same of the line before and the
line after, and whether it has occurred before in the document. The field is trained in numpy on a bounded sample of
labelled documents. Labels are of documents: all lines of a good one are good; of a bad one those that a first model
without transitions calls bad, and the worst in any case. Forward-backward marginals of "bad", weighted by line
length, make one number a document, and a logistic curve fitted on the sample at the labels' own proportions turns
that into the probability that the label is 1.

Defined cases: a null or empty text is one empty line and gets a score; blank lines are lines; a long text is scored
whole, all its lines as one chain; with one label only, or none, every score is that label's share (0.5 if there is
none); labels other than 0 and 1 (null too) aren't learned from, nor rows of ``labels`` whose key no document has; of a
key with several texts one is learned from; of ties the least hash; repeated rows stay; a null key isn't held out, and
keys may be of any type; an empty table gives no rows; columns other than key and text are ignored, whatever they are
called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_text, checkpointed, excerpts, joined, key_remainder, picked_rows, quoted, runs, span_hashes

#: Most labelled documents of each label that are fitted on (excerpts of very long ones).
PER_LABEL = 700
STEPS, RATE, RIDGE = 150, 0.1, 1e-3
BATCH = 1_000_000
GOOD, BAD = 0, 1

_CLASSES = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 blank, 4 loud, 5 stop or comma, 6 other symbol, 7 beyond ASCII
_CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 7
_CLASSES[[9, 11, 12, 13, 32]] = 3
_CLASSES[[33, 63]] = 4
_CLASSES[[44, 46]] = 5
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "!?,."]] = 6


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, each line's length in bytes, and where each text's lines begin (and the end)."""
    data, starts = joined(texts)
    line_end = np.flatnonzero(data == 10)
    line_begin = np.concatenate(([0], line_end[:-1] + 1))
    length = line_end - line_begin
    first = np.searchsorted(line_begin, starts)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    kind = _CLASSES[data]
    bounds = np.concatenate((line_begin, [len(data)]))

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(total[bounds]).astype(float)

    size = np.maximum(length, 1)
    shares = [per_line(kind == k) / size for k in range(1, 8)]
    begin, end = runs((kind != 3) & (data != 10))
    hashes = span_hashes(data, begin, end)
    at = np.searchsorted(line_begin, begin, "right") - 1
    n = np.bincount(at, minlength=len(line_begin)).astype(float)
    words = np.maximum(n, 1)
    again = np.zeros(len(begin), bool)
    for lag in range(1, 5):  # a word that is one of the four before it in the line
        again[lag:] |= (hashes[lag:] == hashes[:-lag]) & (at[lag:] == at[:-lag])

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(at[flags], minlength=len(line_begin)) / words

    last = kind[end - 1]
    whole = span_hashes(data, line_begin, line_end)
    order = np.lexsort((np.arange(len(doc)), whole, doc))
    seen = np.zeros(len(doc), bool)
    seen[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    own = np.column_stack([
        np.log1p(length) / 6, np.log1p(n) / 4, *shares, length / words / 10, share(again), share(end - begin == 1),
        share((last == 6) | (last == 4)), share(kind[begin] == 6), seen, n < 3, length == 0,
        np.isin(data[np.maximum(line_end - 1, 0)], [46, 63, 33]) & (length > 0),
    ]).astype(float)
    before, after = np.zeros_like(own), np.zeros_like(own)
    inner = doc[1:] == doc[:-1]
    before[1:][inner], after[:-1][inner] = own[:-1][inner], own[1:][inner]
    edge = np.column_stack([np.concatenate(([True], ~inner)), np.concatenate((~inner, [True]))])
    return np.hstack([own, before, after, edge, np.ones((len(own), 1))]), length, first


def forward_backward(unary: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each line's state, expected transitions in all, and the log-partition of all chains together.

    unary: lines x 2 log-potentials; trans: 2 x 2 log-potentials; chain i has the lines first[i]..first[i + 1]. All
    chains advance together, a line at a time, the longest first, so those still open are always a prefix.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    top = unary.max(axis=1, keepdims=True)
    e, t = np.exp(unary - top), np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
    longest = int(n[0]) if len(n) else 0
    open_at = [int(np.searchsorted(-n, -k, "left")) for k in range(longest + 1)]  # chains of more than k lines
    for k in range(longest):
        i = begin[: open_at[k]] + k
        a = e[i] if k == 0 else e[i] * (alpha[i - 1] @ t)
        scale[i] = a.sum(axis=1)
        alpha[i] = a / scale[i, None]
    for k in range(longest - 2, -1, -1):
        i = begin[: open_at[k + 1]] + k
        beta[i] = (e[i + 1] * beta[i + 1] / scale[i + 1, None]) @ t.T
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    j = np.flatnonzero(inner)
    pairs = alpha[j - 1][:, :, None] * t * (e[j] * beta[j] / scale[j, None])[:, None, :]
    return gamma, pairs.sum(axis=0), float(np.log(scale).sum() + top.sum())


def _adam(gradient, size: int, steps: int) -> np.ndarray:
    x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for i in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return x


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression on x (with its own constant column), by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # of "bad" against "good"
    trans: np.ndarray
    curve: np.ndarray
    constant: float | None = None

    def badness(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted marginal of "bad" over each text's lines."""
        x, length, first = line_features(texts)
        unary = np.zeros((len(x), 2))
        unary[:, BAD] = ((x - self.mean) / self.spread) @ self.weights
        gamma, _, _ = forward_backward(unary, self.trans, first)
        w = length + 1.0
        return np.add.reduceat(gamma[:, BAD] * w, first[:-1]) / np.add.reduceat(w, first[:-1])

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text's label is 1."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(_curve_inputs(self.badness(texts)) @ self.curve, -30, 30)))


def _curve_inputs(bad: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(bad)), bad, np.log((bad + 1e-3) / (1 + 1e-3 - bad))])


def fit(rows: list[tuple[str | None, int]], counts: dict[int, int]) -> Model:
    """A model of (text, label) rows; ``counts`` are how many rows of each label there are in all."""
    labels = np.array([y for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return Model(*[np.zeros(0)] * 5, constant=float(labels[0]) if len(labels) else 0.5)
    texts = [t for t, _ in rows]
    x, length, first = line_features(texts)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    z = (x - mean) / spread
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    bad_doc = (labels == 0)[of]
    share = np.where(bad_doc, 0.5 / max(1, bad_doc.sum()), 0.5 / max(1, (~bad_doc).sum()))

    def unary_only(w):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        return z.T @ (share * (p - bad_doc)) + RIDGE * w

    margin = z @ _adam(unary_only, z.shape[1], STEPS)
    worst = np.maximum.reduceat(margin, first[:-1])[of]
    state = (bad_doc & ((margin > 0) | (margin >= worst))).astype(int)
    inner = np.ones(len(z), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[j - 1], state[j]), 1)
    n = len(z)

    def gradient(w):
        unary = np.zeros((n, 2))
        unary[:, BAD] = z @ w[:-4]
        gamma, pairs, _ = forward_backward(unary, w[-4:].reshape(2, 2), first)
        return np.concatenate([z.T @ (gamma[:, BAD] - state) / n, ((pairs - seen) / n).reshape(-1)]) + RIDGE * w

    w = _adam(gradient, z.shape[1] + 4, STEPS)
    model = Model(mean, spread, w[:-4], w[-4:].reshape(2, 2), np.zeros(3))
    inputs = _curve_inputs(model.badness(texts))
    weight = np.array([counts[y] for y in labels.tolist()]) / np.array([(labels == y).sum() for y in labels.tolist()])
    model.curve = logistic(inputs, labels.astype(float), weight * len(labels) / weight.sum())
    return model


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_label: int) -> tuple[list[tuple[str | None, int]], dict[int, int]]:
    """(text, label) of at most ``per_label`` labelled documents of each label that aren't held out, and the counts of labels."""
    learn = labels.where((key_remainder("doc_id", modulus) != held) & quoted(label).isin(0, 1)).select(quoted("doc_id").cast("string").alias("k"), quoted(label).cast("int").alias("y"))
    learn = checkpointed(learn.join(docs.select(quoted("doc_id").cast("string").alias("k")).distinct(), "k", "left_semi"))
    counts = {r[0]: r[1] for r in learn.groupBy("y").count().collect()}
    ids = picked_rows(learn, "y", per_label, ["k"])  # at most 2 x per_label rows of 8 bytes
    rows = docs.select(quoted("doc_id").cast("string").alias("k"), quoted("text").cast("string").alias("t"))
    found = rows.join(F.broadcast(ids), F.xxhash64(F.lit(7), "k") == F.col("h")).groupBy("s", "h").agg(F.min_by(F.struct("t"), F.xxhash64("t")).alias("t"))
    return [(r.t, r.s) for r in sorted(excerpts(found.select("s", "h", "t.t"), "t").collect(), key=lambda r: (r.h, r.s))], counts


def score_documents(spark: SparkSession, docs: DataFrame, model, threshold: float, modulus: int, held: int, chars: int = BATCH) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = spark.sparkContext.broadcast(model)
    score = by_text("double", lambda texts: pa.array(np.asarray(shared.value.score(texts), float), pa.float64()), chars)
    out = F.coalesce(key_remainder("doc_id", modulus) == held, F.lit(False))
    rows = docs.select(quoted("doc_id").alias("doc_id"), out.alias("held_out"), score(quoted("text").cast("string")).alias("score"))
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def document_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, modulus: int = 5, held: int = 0, threshold: float = 0.3, per_label: int = PER_LABEL) -> DataFrame:
    """Scores of all documents by a field learned from ``labels.quality`` of those not held out."""
    rows, counts = labelled_sample(spark, docs, labels, "quality", modulus, held, per_label)
    return score_documents(spark, docs, fit(rows, counts), threshold, modulus, held)
